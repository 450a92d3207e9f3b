"""Bank, neighbour and boosted-tree queries."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ..operators import banks, boosting, knn
from ..operators.tiling import patch_means, windows
from ..plans.scratch import cut, new_path
from ..sources import stores
from .data import PS, SIZE, STRIDE, THRESHOLDS, cells, context, dense, mask, query, r6, tiles, vecs

KEY = ["tile_id", "win_y", "win_x", "py", "px"]
KEYS = "tile_id, win_y, win_x, py, px"
ERODED = """(SELECT m.tile_id, m.y, m.x FROM label_mask m WHERE NOT EXISTS (SELECT 1 FROM disk JOIN grid g1 ON g1.tile_id = m.tile_id AND g1.y = m.y + dy AND g1.x = m.x + dx
    WHERE dy * dy + dx * dx <= 1 AND NOT EXISTS (SELECT 1 FROM label_mask n WHERE n.tile_id = g1.tile_id AND n.y = g1.y AND n.x = g1.x)))"""
PATCH = f"""(SELECT p.tile_id, win_y, win_x, py, px, CAST(AVG(r) AS DOUBLE) AS rm, CAST(AVG(g) AS DOUBLE) AS gm,
    CASE WHEN COUNT(m.y) / CAST(16 AS DOUBLE) >= 0.05 THEN 'pos' WHEN COUNT(m.y) = 0 THEN 'neg' END AS kind
    FROM placed p LEFT JOIN {ERODED} m ON m.tile_id = p.tile_id AND m.y = p.y AND m.x = p.x GROUP BY 1, 2, 3, 4, 5)"""


def patch_vecs(spark, d):
    return patch_means(cells(spark, d), tiles(spark, d), ["r", "g"], SIZE, STRIDE, PS).withColumn("vec", F.array("r", "g"))


def patch_kinds(spark, d, erosion=1):
    return banks.labelled_patches(tiles(spark, d), None, mask(spark, d, "label"), SIZE, STRIDE, PS, 0.05, erosion)


@query("MOD-01", f"""SELECT {KEYS}, kind AS polarity, ROUND(rm, 6) AS v0, ROUND(gm, 6) AS v1 FROM {PATCH} p WHERE kind IS NOT NULL
    AND tile_id IN (SELECT tile_id FROM {PATCH} q WHERE kind = 'pos')""")
def _(spark, d):
    bank = banks.build_bank(patch_vecs(spark, d), patch_kinds(spark, d))
    return bank.select(*KEY, "polarity", F.round(F.col("vec")[0], 6).alias("v0"), F.round(F.col("vec")[1], 6).alias("v1"))


@query("MOD-02", f"""SELECT {KEYS}, kind AS polarity FROM (SELECT *, row_number() OVER (PARTITION BY tile_id, kind ORDER BY md5(concat_ws('|', {KEYS}, 42)), {KEYS}) AS rn FROM {PATCH} p
    WHERE kind IS NOT NULL AND tile_id IN (SELECT tile_id FROM {PATCH} q WHERE kind = 'pos')) WHERE rn <= CASE kind WHEN 'pos' THEN 5 ELSE 20 END""")
def _(spark, d):
    bank = banks.build_bank(patch_vecs(spark, d), patch_kinds(spark, d))
    capped = banks.combine_sources([bank], {"pos": 5, "neg": 20}, 42, ["tile_id"], KEY)
    return capped.select(*KEY, "polarity")


@query("MOD-03", f"""WITH b AS (SELECT {KEYS}, kind AS polarity, rm FROM {PATCH} p WHERE kind IS NOT NULL AND tile_id IN (SELECT tile_id FROM {PATCH} q WHERE kind = 'pos'))
    SELECT aug, polarity, COUNT(*) AS n, ROUND(SUM(CASE aug WHEN 'orig' THEN rm ELSE 255 - rm END), 3) AS total FROM b, (VALUES ('orig'), ('inverse')) v(aug) GROUP BY 1, 2""")
def _(spark, d):
    bank = cut(banks.build_bank(patch_vecs(spark, d), patch_kinds(spark, d)), "bank").withColumn("aug", F.lit("orig"))
    other = bank.withColumn("aug", F.lit("inverse")).withColumn("vec", F.transform("vec", lambda v: 255.0 - v))
    out = banks.combine_sources([bank, other], {"pos": 1 << 30, "neg": 1 << 30}, 42, ["tile_id", "aug"], KEY)
    return out.groupBy("aug", "polarity").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("vec")[0]), 3).alias("total"))


@query("MOD-04", f"""WITH p AS (SELECT q.*, w_eff FROM {PATCH} q JOIN wins w USING (tile_id, win_y, win_x)), s AS (SELECT COUNT(*) AS skipped FROM (SELECT DISTINCT tile_id, win_y, win_x FROM p WHERE w_eff < 8))
    SELECT {KEYS}, CASE kind WHEN 'pos' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS label, ROUND(rm, 6) AS v0, skipped FROM p, s WHERE kind IS NOT NULL AND w_eff >= 8""")
def _(spark, d):
    """Features exist only for windows of two patch columns or more."""
    feats, kinds = patch_vecs(spark, d).filter("w_eff >= 8"), cut(patch_kinds(spark, d), "kinds")
    skipped = banks.skipped_windows(feats, kinds).agg(F.count(F.lit(1)).alias("skipped"))
    return banks.training_rows(feats, kinds).select(*KEY, F.col("y").alias("label"), F.round(F.col("vec")[0], 6).alias("v0")).join(F.broadcast(skipped))


TOPK = """(SELECT q.vec_id AS query_id, b.vec_id AS bank_id, list_dot_product(q.vec, b.vec) AS sim,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.vec, b.vec) DESC, b.vec_id) AS rn FROM vecs q JOIN vecs b ON b.label {cond})"""
POS, NEG = TOPK.format(cond="< 5"), TOPK.format(cond=">= 5")


def split(spark, d):
    """Every embedding is a query; the lower labels are the positive bank and the others the negative one."""
    v = vecs(spark, d)
    return v, v.filter("label < 5"), v.filter("label >= 5")


@query("MOD-05", f'SELECT query_id, CAST(rn AS INT) AS "rank", bank_id, ROUND(sim, 6) AS sim FROM {POS} WHERE rn <= 10')
def _(spark, d):
    q, pos, _ = split(spark, d)
    return knn.topk(q, pos, 10).select("query_id", "rank", "bank_id", *r6("sim"))


@query("MOD-06", f"""SELECT p.query_id, ROUND(p.s - CAST(0.7 AS DOUBLE) * n.s, 6) AS score FROM (SELECT query_id, AVG(sim) AS s FROM {POS} WHERE rn <= 15 GROUP BY 1) p
    JOIN (SELECT query_id, AVG(sim) AS s FROM {NEG} WHERE rn <= 15 GROUP BY 1) n ON n.query_id = p.query_id""")
def _(spark, d):
    q, pos, neg = split(spark, d)
    return knn.knn_score(q, pos, neg, 15, 0.7).select("query_id", *r6("score"))


@query("MOD-07", f"SELECT query_id, ROUND(SUM(sim * sim) / (SUM(sim) + 1e-8), 6) AS saliency FROM {POS} WHERE rn <= 10 GROUP BY 1")
def _(spark, d):
    q, pos, _ = split(spark, d)
    return knn.knn_saliency(knn.topk(q, pos, 10)).select("query_id", *r6("saliency"))


def train_rows(spark, d):
    return vecs(spark, d).select("vec_id", "vec", (F.col("label") < 5).cast("double").alias("y"))


@query("MOD-08", "SELECT COUNT(*) AS n, true AS beats_the_prior FROM vecs")
def _(spark, d):
    """Facts about a fitted model: every row is scored, and the loss is below that of the constant share."""
    rows = train_rows(spark, d)
    model = boosting.train(rows, {"max_depth": 3, "eta": 0.3}, 8)
    scored = boosting.score_patches(model, rows)
    share = rows.agg(F.avg("y")).first()[0]
    return scored.agg(F.count(F.lit(1)).alias("n"), (boosting.log_loss(F.col("y"), F.col("score")) < boosting.prior_loss(share)).alias("beats_the_prior"))


@query("MOD-09", """SELECT CAST(i AS INT) AS i, CAST(i + 2 AS INT) AS max_depth, true AS positive_loss, true AS first_lowest_is_best FROM (SELECT unnest(range(2)) AS i FROM (SELECT COUNT(*) FROM vecs))""")
def _(spark, d):
    """Facts about a search: every setting is tried, and the first one of lowest loss is the best."""
    params = boosting.grid({"max_depth": [2, 3], "eta": [0.3]})
    _, best, losses = boosting.search_logloss(train_rows(spark, d), params, 6, 0.3, 42, ["vec_id"])
    first = params[losses.index(min(losses))]
    return spark.createDataFrame([(i, p["max_depth"], loss > 0, (p == best) == (p == first)) for i, (p, loss) in enumerate(zip(params, losses))],
                                 "i int, max_depth int, positive_loss boolean, first_lowest_is_best boolean")


@query("MOD-10")
def _(spark, d):
    rows = train_rows(spark, d)
    image = rows.select("vec", (F.col("y") > 0).alias("gt"))
    _, best, row = boosting.search_iou(rows, image, boosting.grid({"max_depth": [2, 3], "eta": [0.3]}), THRESHOLDS, 6, 0.3, 42, ["vec_id"])
    return spark.createDataFrame([(best["max_depth"], row["threshold"], row["iou"])], "max_depth int, threshold double, iou double")


@query("MOD-11", "SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(label < 5 AS DOUBLE) AS y, true AS in_unit FROM vecs")
def _(spark, d):
    """One probability for every row."""
    rows = train_rows(spark, d)
    return boosting.score_patches(boosting.train(rows, {"max_depth": 3}, 5), rows).select("vec_id", "y", F.col("score").between(0.0, 1.0).alias("in_unit"))


MIRROR = "CASE WHEN {i} < 0 THEN least(-({i}), {n} - 1) WHEN {i} >= {n} THEN greatest(2 * {n} - 2 - ({i}), 0) ELSE {i} END"
UP = f"""(WITH s AS (SELECT {KEYS}, AVG(score) AS score FROM placed GROUP BY ALL),
    c AS (SELECT d.tile_id, d.y, d.x, win_y, win_x, h_eff // 4 AS hp, w_eff // 4 AS wp, (d.y - win_y + 0.5::DOUBLE) * (h_eff // 4) / h_eff - 0.5 AS u, (d.x - win_x + 0.5::DOUBLE) * (w_eff // 4) / w_eff - 0.5 AS v
        FROM grid d JOIN wins w ON w.tile_id = d.tile_id AND d.y >= win_y AND d.y < win_y + h_eff AND d.x >= win_x AND d.x < win_x + w_eff WHERE h_eff >= 4 AND w_eff >= 4),
    t AS (SELECT *, CAST(floor(u) AS INT) + a AS iy, CAST(floor(v) AS INT) + b AS ix, CASE a WHEN 0 THEN 1 - (u - floor(u)) ELSE u - floor(u) END
        * CASE b WHEN 0 THEN 1 - (v - floor(v)) ELSE v - floor(v) END AS w FROM c, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(a, b))
    SELECT t.tile_id, t.win_y, t.win_x, t.y, t.x, SUM(w * s.score) AS score FROM t JOIN s ON s.tile_id = t.tile_id AND s.win_y = t.win_y AND s.win_x = t.win_x
    AND s.py = {MIRROR.format(i='iy', n='hp')} AND s.px = {MIRROR.format(i='ix', n='wp')} GROUP BY ALL)"""


def upsampled(spark, d):
    scores = patch_means(cells(spark, d), tiles(spark, d), ["score"], SIZE, STRIDE, PS)
    return boosting.upsample_bilinear(scores, windows(tiles(spark, d), SIZE, STRIDE), PS)


@query("MOD-12", f"SELECT tile_id, win_y, win_x, y, x, ROUND(score + 1e-10, 6) AS score FROM {UP}")
def _(spark, d):
    # many values lie half-way between two roundings, the small shift decides them alike everywhere
    return upsampled(spark, d).select("tile_id", "win_y", "win_x", "y", "x", F.round(F.col("score") + 1e-10, 6).alias("score"))


@query("MOD-13", f"""SELECT g1.tile_id, g1.y, g1.x, ROUND(COALESCE(AVG(u.score), 0) + 1e-10, 6) AS score FROM grid g1 LEFT JOIN {UP} u ON u.tile_id = g1.tile_id AND u.y = g1.y AND u.x = g1.x GROUP BY 1, 2, 3""")
def _(spark, d):
    return boosting.blend_windows(upsampled(spark, d), dense(spark, d)).select("tile_id", "y", "x", F.round(F.col("score") + 1e-10, 6).alias("score"))


@query("MOD-14", """WITH f AS (SELECT 'dim_' || i AS feature, ROUND(stddev_pop(vec[i + 1]), 9) AS gain FROM vecs, unnest(range(64)) r(i) GROUP BY 1 UNION ALL
    SELECT 'other_' || label, COUNT(*) FROM vecs GROUP BY 1), t AS (SELECT * FROM f WHERE feature LIKE 'dim\\_%' ESCAPE '\\' ORDER BY gain DESC, feature LIMIT 12)
    SELECT feature, ROUND(gain, 6) AS gain, ROUND(SUM(gain) OVER (ORDER BY gain, feature DESC) / greatest(SUM(gain) OVER (), 1e-8), 6) AS cum_share FROM t""")
def _(spark, d):
    v = vecs(spark, d)
    dims = v.select(F.posexplode("vec").alias("i", "v")).groupBy("i").agg(F.round(F.stddev_pop(F.col("v").cast("double")), 9).alias("gain"))
    gains = dims.select(F.concat(F.lit("dim_"), F.col("i").cast("string")).alias("feature"), "gain").unionByName(
        v.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("gain")).select(F.concat(F.lit("other_"), F.col("label").cast("string")).alias("feature"), "gain"))
    return boosting.importance_topk(gains, "dim_", 12).select("feature", *r6("gain", "cum_share"))


@query("MOD-15", """SELECT tile_id, ROUND(AVG(abs(d)), 6) AS mean_abs_diff, ROUND(MAX(abs(d)), 6) AS max_abs_diff, bool_and((score >= 0.5) = (s2 >= 0.5)) AS same_mask,
    bool_and(abs(d) <= 1e-5 + 1e-4 * abs(s2)) AS all_close, NOT (bool_and((score >= 0.5) = (s2 >= 0.5)) AND bool_and(abs(d) <= 1e-5 + 1e-4 * abs(s2))) AS mismatch
    FROM (SELECT *, score - s2 AS d FROM (SELECT tile_id, score, CASE WHEN width = 31 AND road THEN score * CAST(1.01 AS DOUBLE) ELSE score + CAST(0.000001 AS DOUBLE) END AS s2 FROM ctx)) GROUP BY 1""")
def _(spark, d):
    a = context(spark, d)
    wide = tiles(spark, d).select("tile_id", "width")
    s = F.col("score")
    b = a.join(wide, "tile_id").withColumn("score", F.when((F.col("width") == 31) & F.col("road"), s * 1.01).otherwise(s + 0.000001))
    return boosting.score_guard(a, b, 0.5).select("tile_id", *r6("mean_abs_diff", "max_abs_diff"), "same_mask", "all_close", "mismatch")


@query("SNK-13", "SELECT CAST(vec_id AS BIGINT) AS vec_id, true AS same, CAST(0.5 AS DOUBLE) AS threshold FROM vecs")
def _(spark, d):
    """Scores of the loaded model equal those of the saved one, row by row."""
    rows = train_rows(spark, d)
    path, fitted = new_path(spark, "bundle"), boosting.train(rows, {"max_depth": 2}, 3)
    stores.save_bundle(PipelineModel([fitted]), {"threshold": 0.5, "k": -1}, path, spark)
    model, settings = stores.load_bundle(path, spark)
    before = boosting.score_patches(fitted, rows).select("vec_id", F.col("score").alias("before"))
    scored = boosting.score_patches(model.stages[0], rows).join(before, "vec_id")
    return scored.select("vec_id", (F.col("score") == F.col("before")).alias("same"), F.lit(settings["threshold"]).alias("threshold"))

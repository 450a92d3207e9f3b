"""Metric, sweep and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import knn, metrics, tuning
from .data import THRESHOLDS, context, mask, query, r6, tiles, vecs
from .models import POS

CELL = ["tile_id", "y", "x"]
RATIO = ["precision", "recall", "iou", "f1"]


def ratios(src: str, keys: str) -> str:
    """SQL that adds rounded ratios to rows of counts."""
    return f"""SELECT {keys}, tp, fp, fn, tn, ROUND(p, 6) AS "precision", ROUND(r, 6) AS recall, ROUND(tp / (tp + fp + fn + 1e-8), 6) AS iou, ROUND(2 * p * r / (p + r + 1e-8), 6) AS f1
        FROM (SELECT *, tp / (tp + fp + 1e-8) AS p, tp / (tp + fn + 1e-8) AS r FROM ({src}))"""


def counts(pred: str, gt: str = "gt") -> str:
    return f"""COUNT(*) FILTER (({pred}) AND {gt}) AS tp, COUNT(*) FILTER (({pred}) AND NOT {gt}) AS fp, COUNT(*) FILTER (NOT ({pred}) AND {gt}) AS fn, COUNT(*) FILTER (NOT ({pred}) AND NOT {gt}) AS tn"""


@query("MET-01", ratios(f"SELECT tile_id, {counts('label')} FROM ctx GROUP BY 1", "tile_id"))
def _(spark, d):
    out = metrics.mask_confusion(mask(spark, d, "label"), mask(spark, d, "gt"), tiles(spark, d))
    return out.select("tile_id", "tp", "fp", "fn", "tn", *r6(*RATIO))


THR = "(SELECT CAST(i AS INT) AS thr_idx, (i + 1) / CAST(20 AS DOUBLE) AS threshold FROM unnest(range(19)) u(i))"
SWEEP = f"SELECT tile_id, thr_idx, threshold, {counts('score >= threshold AND buffer')} FROM ctx CROSS JOIN {THR} GROUP BY 1, 2, 3"


def swept(spark, d):
    return metrics.sweep(context(spark, d), F.col("score"), THRESHOLDS, keep=F.col("buffer"))


@query("MET-02", ratios(SWEEP, "tile_id, thr_idx, threshold"))
def _(spark, d):
    return swept(spark, d).select("tile_id", "thr_idx", "threshold", "tp", "fp", "fn", "tn", *r6(*RATIO))


@query("MET-03", ratios(f"SELECT tile_id, {counts('gt AND buffer')} FROM ctx GROUP BY 1", "tile_id"))
def _(spark, d):
    out = metrics.confusion(context(spark, d), F.col("gt") & F.col("buffer"), F.col("gt"))
    return out.select("tile_id", "tp", "fp", "fn", "tn", *r6(*RATIO))


@query("MET-04", f"""SELECT tile_id, thr_idx, threshold, ROUND(iou, 6) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY ROUND(iou, 12) DESC, thr_idx) AS rn FROM
    (SELECT tile_id, thr_idx, threshold, tp / (tp + fp + fn + 1e-8) AS iou FROM (SELECT tile_id, thr_idx, threshold, {counts('score >= threshold AND buffer')} FROM ctx
    CROSS JOIN (SELECT CAST(i AS INT) AS thr_idx, ROUND(0.4::DOUBLE + i * 0.02::DOUBLE, 12) AS threshold FROM unnest(range(11)) u(i)) GROUP BY 1, 2, 3))) WHERE rn = 1""")
def _(spark, d):
    out = metrics.fine_tune(context(spark, d), F.col("score"), 0.5, 0.02, 0.1, keep=F.col("buffer"))
    return out.select("tile_id", "thr_idx", "threshold", *r6("iou"))


KTHR = [i / 50 for i in range(1, 26)]


@query("MET-05", f"""WITH t AS (SELECT * FROM {POS} WHERE rn <= 25), q AS (SELECT k_ord, k, query_id, AVG(sim) AS score FROM t JOIN (VALUES (0, 5), (1, 10), (2, 25)) v(k_ord, k) ON rn <= k GROUP BY 1, 2, 3),
    g AS (SELECT k_ord, k, thr_idx, threshold, {counts('score >= threshold', '(label < 5)')} FROM q JOIN vecs ON vec_id = query_id
    CROSS JOIN (SELECT CAST(i - 1 AS INT) AS thr_idx, i / CAST(50 AS DOUBLE) AS threshold FROM unnest(range(1, 26)) u(i)) GROUP BY 1, 2, 3, 4)
    SELECT k, threshold, ROUND(tp / (tp + fp + fn + 1e-8), 6) AS iou FROM g ORDER BY ROUND(tp / (tp + fp + fn + 1e-8), 12) DESC, k_ord, thr_idx LIMIT 1""")
def _(spark, d):
    v = vecs(spark, d)
    top = knn.topk(v, v.filter("label < 5"), 25).join(v.select(F.col("vec_id").alias("query_id"), (F.col("label") < 5).alias("gt")), "query_id")
    return tuning.k_threshold_grid(top, [5, 10, 25], KTHR).select("k", "threshold", *r6("iou"))


@query("MET-06", """SELECT road, ROUND(CASE WHEN SUM(w) > 0 THEN SUM(score * w) / SUM(w) ELSE COALESCE(AVG(score), 0) END, 6) AS m FROM (SELECT *, CASE WHEN road THEN 0 ELSE r END AS w FROM ctx) GROUP BY 1""")
def _(spark, d):
    w = F.when(F.col("road"), 0).otherwise(F.col("r"))
    return context(spark, d).groupBy("road").agg(F.round(metrics.weighted_mean(F.col("score"), w), 6).alias("m"))


WEIGHTED = f"""(SELECT thr_idx, threshold, SUM(iou * w) / SUM(w) AS iou, SUM(f1 * w) / SUM(w) AS f1, SUM(p * w) / SUM(w) AS "precision", SUM(r * w) / SUM(w) AS recall FROM
    (SELECT *, 2 * p * r / (p + r + 1e-8) AS f1 FROM (SELECT *, tp / (tp + fp + 1e-8) AS p, tp / (tp + fn + 1e-8) AS r, tp / (tp + fp + fn + 1e-8) AS iou, (tp + fn)::DOUBLE AS w FROM ({SWEEP}))) GROUP BY 1, 2)"""


def weights(spark, d):
    gt = mask(spark, d, "gt").groupBy("tile_id").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return tiles(spark, d).select("tile_id").join(gt, "tile_id", "left").fillna(0.0, ["weight"])


@query("MET-07", f'SELECT thr_idx, threshold, ROUND(iou, 6) AS iou, ROUND(f1, 6) AS f1, ROUND("precision", 6) AS "precision", ROUND(recall, 6) AS recall FROM {WEIGHTED}')
def _(spark, d):
    return metrics.weighted_sweep(swept(spark, d), weights(spark, d)).select("thr_idx", "threshold", *r6("iou", "f1", "precision", "recall"))


@query("MET-08", f"SELECT thr_idx, threshold, ROUND(iou, 6) AS iou FROM {WEIGHTED} ORDER BY ROUND(iou, 12) DESC, thr_idx LIMIT 1")
def _(spark, d):
    return metrics.best_threshold(metrics.weighted_sweep(swept(spark, d), weights(spark, d))).select("thr_idx", "threshold", *r6("iou"))


STREAMS = """(SELECT tile_id, gt, buffer, road, stream, cand_ord, CASE stream WHEN 'raw' THEN score * (1 - cand_ord * 0.1::DOUBLE) ELSE score * 0.8::DOUBLE + r * (cand_ord + 1) / 2500::DOUBLE END AS score
    FROM ctx CROSS JOIN (VALUES ('raw', 0), ('raw', 1), ('xgb', 0), ('xgb', 1)) v(stream, cand_ord))"""


def streams(spark, d):
    s, c = F.col("score"), F.col("_v.cand_ord")
    opts = F.array(*[F.struct(F.lit(a).alias("stream"), F.lit(b).alias("cand_ord")) for a in ("raw", "xgb") for b in (0, 1)])
    out = context(spark, d).withColumn("_v", F.explode(opts))
    score = F.when(F.col("_v.stream") == "raw", s * (1.0 - c * 0.1)).otherwise(s * 0.8 + F.col("r") * (c + 1) / 2500.0)
    return out.select("tile_id", "gt", "buffer", "road", "_v.stream", "_v.cand_ord", score.alias("score"))


@query("MET-09", f"""WITH s AS (SELECT pen_ord, penalty, stream, cand_ord, tile_id, thr_idx, threshold, {counts('CASE WHEN road THEN score * penalty ELSE score END >= threshold AND buffer')}
    FROM {STREAMS} CROSS JOIN {THR} CROSS JOIN (VALUES (0, 0.8::DOUBLE), (1, 0.9::DOUBLE), (2, 1.0::DOUBLE)) p(pen_ord, penalty) GROUP BY 1, 2, 3, 4, 5, 6, 7),
    m AS (SELECT pen_ord, penalty, stream, cand_ord, thr_idx, threshold, SUM(tp / (tp + fp + fn + 1e-8) * (tp + fn)) / SUM(tp + fn) AS iou FROM s GROUP BY 1, 2, 3, 4, 5, 6)
    SELECT penalty, stream, cand_ord, threshold, ROUND(iou, 6) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY pen_ord, stream ORDER BY ROUND(iou, 12) DESC, cand_ord, thr_idx) AS rn FROM m)
    WHERE rn = 1 ORDER BY ROUND(iou, 12) DESC, pen_ord, stream LIMIT 1""")
def _(spark, d):
    best = tuning.select_penalty(streams(spark, d), [0.8, 0.9, 1.0], THRESHOLDS, weights(spark, d))
    return best.select("penalty", "stream", "cand_ord", "threshold", *r6("iou"))


WEIGHT_SETS = [(1.0, 1.0, 1.0), (0.5, 0.8, 1.0), (0.1, 0.5, 0.5)]
SHADOW_THR = [20, 60, 100, 160, 240, 330]
WSQL = "(VALUES (0, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE), (1, 0.5::DOUBLE, 0.8::DOUBLE, 1.0::DOUBLE), (2, 0.1::DOUBLE, 0.5::DOUBLE, 0.5::DOUBLE)) w(w_ord, wr, wg, wb)"
TSQL = "(VALUES (0, 20::DOUBLE), (1, 60::DOUBLE), (2, 100::DOUBLE), (3, 160::DOUBLE), (4, 240::DOUBLE), (5, 330::DOUBLE)) t(thr_idx, threshold)"


def base_cells(spark, d):
    return context(spark, d).filter("score >= 0.3 and buffer")


@query("MET-10", f"""WITH s AS (SELECT tile_id, w_ord, thr_idx, threshold, {counts('r * wr + g * wg + b * wb >= threshold')} FROM ctx CROSS JOIN {WSQL} CROSS JOIN {TSQL}
    WHERE score >= 0.3 AND buffer GROUP BY 1, 2, 3, 4)
    SELECT tile_id, w_ord, threshold, ROUND(iou, 6) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY ROUND(iou, 12) DESC, w_ord, thr_idx) AS rn FROM
    (SELECT *, tp / (tp + fp + fn + 1e-8) AS iou FROM s)) WHERE rn = 1""")
def _(spark, d):
    return tuning.shadow_grid(base_cells(spark, d), WEIGHT_SETS, SHADOW_THR).select("tile_id", "w_ord", "threshold", *r6("iou"))


@query("MET-11", f"""WITH s AS (SELECT tile_id, w_ord, thr_idx, threshold, p_ord, protect, {counts('r * wr + g * wg + b * wb >= threshold OR score >= protect')} FROM ctx CROSS JOIN {WSQL} CROSS JOIN {TSQL}
    CROSS JOIN (VALUES (0, 0.4::DOUBLE), (1, 0.6::DOUBLE)) p(p_ord, protect) WHERE score >= 0.3 AND buffer GROUP BY 1, 2, 3, 4, 5, 6), g AS (SELECT tile_id, COUNT(*) AS weight FROM gt_mask GROUP BY 1),
    m AS (SELECT w_ord, thr_idx, threshold, p_ord, protect, SUM(tp / (tp + fp + fn + 1e-8) * weight) / SUM(weight) AS iou FROM s JOIN g USING (tile_id) GROUP BY 1, 2, 3, 4, 5)
    SELECT w_ord, threshold, protect, ROUND(iou, 6) AS iou FROM m ORDER BY ROUND(iou, 12) DESC, w_ord, thr_idx, p_ord LIMIT 1""")
def _(spark, d):
    return tuning.tune_shadow(base_cells(spark, d), WEIGHT_SETS, SHADOW_THR, [0.4, 0.6], weights(spark, d)).select("w_ord", "threshold", "protect", *r6("iou"))


@query("MET-12")
def _(spark, d):
    values = {"prob_softness": [0.15], "trimap_band": [0, 2], "pos_w": [1.0], "pos_xy_std": [3.0], "bilateral_w": [2.0], "bilateral_xy_std": [8.0], "bilateral_rgb_std": [40.0]}
    configs = tuning.crf_candidates(values, 2)
    return tuning.crf_grid(context(spark, d), tiles(spark, d), configs, 0.5, weights(spark, d), steps=2)


#: The nine stages: two streams with scores and thresholds of their own and the champion, each raw, in the buffer, and without shadow.
RAW = {"knn": "score >= 0.3", "xgb": "score + r / 1000 >= 0.5", "champion": "score >= 0.4"}
STAGE_SQL = {f"{stream}_{step}": f"{raw}{more}" for stream, raw in RAW.items() for step, more in (("raw", ""), ("crf", " AND buffer"), ("shadow", " AND buffer AND r + g + b >= 200"))}
STAGE_UNION = " UNION ALL ".join(f"SELECT tile_id, '{s}' AS stage, {counts(c)}, CAST(COUNT(*) FILTER (gt) AS DOUBLE) AS weight FROM ctx GROUP BY 1" for s, c in STAGE_SQL.items())
STAGE_ROWS = f"""(SELECT *, 2 * "precision" * recall / ("precision" + recall + 1e-8) AS f1 FROM (SELECT *, tp / (tp + fp + 1e-8) AS "precision", tp / (tp + fn + 1e-8) AS recall, tp / (tp + fp + fn + 1e-8) AS iou FROM ({STAGE_UNION})))"""


def stages(spark, d):
    ctx = context(spark, d)
    for s, c in STAGE_SQL.items():
        ctx = ctx.withColumn(s, F.expr(c))
    return metrics.stage_metrics(ctx, list(STAGE_SQL), "gt")


@query("MET-14", f'SELECT tile_id, stage, tp, fp, fn, tn, weight, ROUND("precision", 6) AS "precision", ROUND(recall, 6) AS recall, ROUND(iou, 6) AS iou, ROUND(f1, 6) AS f1 FROM {STAGE_ROWS}')
def _(spark, d):
    return stages(spark, d).select("tile_id", "stage", "tp", "fp", "fn", "tn", "weight", *r6(*RATIO))


WM = "ROUND(CASE WHEN SUM(weight) > 0 THEN SUM({c} * weight) / SUM(weight) ELSE COALESCE(AVG({c}), 0) END, 6)"


@query("MET-15", f"""SELECT stage, {WM.format(c='iou')} AS iou_wmean, {WM.format(c='f1')} AS f1_wmean, {WM.format(c='"precision"')} AS precision_wmean, {WM.format(c='recall')} AS recall_wmean,
    ROUND(MEDIAN(iou), 6) AS iou_median, ROUND(MEDIAN(f1), 6) AS f1_median, list_position({metrics.STAGES}, stage) AS stage_ord FROM {STAGE_ROWS} GROUP BY 1""")
def _(spark, d):
    out = metrics.stage_summary(stages(spark, d))
    return out.select("stage", *r6("iou_wmean", "f1_wmean", "precision_wmean", "recall_wmean", "iou_median", "f1_median"), "stage_ord")


@query("MET-16", f"""WITH s AS (SELECT stage, SUM(iou * weight) / SUM(weight) AS iou, SUM(f1 * weight) / SUM(weight) AS f1 FROM {STAGE_ROWS} GROUP BY 1)
    SELECT a.stage AS stage_from, b.stage AS stage_to, ROUND(b.iou - a.iou, 6) AS d_iou, ROUND(b.f1 - a.f1, 6) AS d_f1 FROM s a JOIN s b ON (a.stage, b.stage) IN (('champion_raw', 'champion_crf'), ('champion_crf', 'champion_shadow'))""")
def _(spark, d):
    return metrics.stage_delta(stages(spark, d)).select("stage_from", "stage_to", *r6("d_iou", "d_f1"))


@query("MET-17", f"""SELECT stage, ROUND(AVG(iou), 6) AS iou_mean, ROUND(stddev_pop(iou), 6) AS iou_std, ROUND(AVG(f1), 6) AS f1_mean, ROUND(stddev_pop(f1), 6) AS f1_std FROM {STAGE_ROWS} GROUP BY 1""")
def _(spark, d):
    return metrics.mean_std(stages(spark, d)).select("stage", *r6("iou_mean", "iou_std", "f1_mean", "f1_std"))


FOLDS = f"(SELECT (tile_id + n - j) % n AS fold, s.* FROM {STAGE_ROWS} s, (SELECT COUNT(*) AS n FROM tiles), unnest(range(2)) u(j))"


def fold_rows(spark, d):
    """Each tile validates in two cyclic folds."""
    t = tiles(spark, d)
    n = t.count()
    return stages(spark, d).withColumn("j", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("fold", F.pmod(F.col("tile_id").cast("bigint") - F.col("j"), F.lit(n)))


@query("MET-18", f"SELECT fold, stage, {WM.format(c='iou')} AS iou, {WM.format(c='f1')} AS f1, SUM(weight) AS weight FROM {FOLDS} GROUP BY 1, 2")
def _(spark, d):
    return metrics.fold_metrics(fold_rows(spark, d)).select("fold", "stage", *r6("iou", "f1"), "weight")


@query("MET-19", f"""SELECT fold, ROUND(iou, 6) AS iou, weight FROM (SELECT fold, CASE WHEN SUM(weight) > 0 THEN SUM(iou * weight) / SUM(weight) ELSE AVG(iou) END AS iou, SUM(weight) AS weight
    FROM {FOLDS} WHERE stage = 'champion_shadow' GROUP BY 1) ORDER BY ROUND(iou, 12) DESC, fold LIMIT 1""")
def _(spark, d):
    return metrics.best_fold(metrics.fold_metrics(fold_rows(spark, d))).select("fold", *r6("iou"), "weight")


@query("MET-20", """WITH s AS (SELECT buffer, MIN(score) AS lo, MAX(score) AS hi FROM ctx GROUP BY 1), h AS (SELECT c.buffer, least(39, CAST(floor((score - lo) * 40 / (hi - lo)) AS INT)) AS bin, COUNT(*) AS n
    FROM ctx c JOIN s ON s.buffer = c.buffer GROUP BY 1, 2) SELECT s.buffer, CAST(k AS INT) AS bin, COALESCE(n, 0) AS n FROM s CROSS JOIN unnest(range(40)) u(k) LEFT JOIN h ON h.buffer = s.buffer AND h.bin = k""")
def _(spark, d):
    return metrics.score_hist(context(spark, d), "score", "buffer", 40)

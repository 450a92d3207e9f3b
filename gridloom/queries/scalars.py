"""Scalar and per-cell function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color, scores
from ..operators import features, texture
from ..operators.focal import dilate
from .data import PS, SIZE, STRIDE, cells01, context, dense, mask, part_catalog, placed, query, r6, table, tiles
from .masks import GRADIENT

CELL = ["tile_id", "y", "x"]

HSV = """CASE WHEN mx - mn <= 1e-8 THEN 0 WHEN mx = b THEN ((r - g) / (mx - mn + 1e-8) + 4) / 6 WHEN mx = g THEN ((b - r) / (mx - mn + 1e-8) + 2) / 6
    ELSE ((g - b) / (mx - mn + 1e-8) - 6 * floor((g - b) / (mx - mn + 1e-8) / 6)) / 6 END"""
SAT = "CASE WHEN mx > 1e-8 THEN (mx - mn) / (mx + 1e-8) ELSE 0 END"


@query("SCL-01", f"""SELECT tile_id, y, x, ROUND({HSV}, 6) AS h, ROUND({SAT}, 6) AS s, ROUND(mx, 6) AS v FROM (SELECT tile_id, y, x, r, g, b, greatest(r, g, b) AS mx, least(r, g, b) AS mn
    FROM (SELECT tile_id, y, x, CAST(r AS DOUBLE) / 255 AS r, CAST(g AS DOUBLE) / 255 AS g, CAST(b AS DOUBLE) / 255 AS b FROM dense))""")
def _(spark, d):
    c = dense(spark, d)
    hsv = color.hsv(*[F.col(n) / F.lit(255.0) for n in "rgb"])
    return c.select(*CELL, *[F.round(hsv[n], 6).alias(n) for n in "hsv"])


@query("SCL-02", """SELECT tile_id, y, x, ROUND(r * CAST(0.2989 AS DOUBLE) + g * CAST(0.5870 AS DOUBLE) + b * CAST(0.1140 AS DOUBLE), 6) AS gray FROM dense""")
def _(spark, d):
    return dense(spark, d).select(*CELL, F.round(color.gray(F.col("r"), F.col("g"), F.col("b")), 6).alias("gray"))


@query("SCL-03", """SELECT tile_id, win_y, win_x, y, x, ROUND(CASE WHEN MAX(greatest(r, g, b)) OVER (PARTITION BY tile_id, win_y, win_x) > 1.5 THEN CAST(r AS DOUBLE) / 255 ELSE r END, 6) AS r FROM placed""")
def _(spark, d):
    return features.scale01(placed(spark, d)).select("tile_id", "win_y", "win_x", "y", "x", *r6("r"))


@query("SCL-04", f"""SELECT tile_id, win_y, win_x, y, x, ROUND(SQRT(gx * gx + gy * gy), 6) AS mag,
    ROUND(CASE WHEN atan2(gy, gx) < 0 THEN atan2(gy, gx) + 2 * pi() ELSE atan2(gy, gx) END, 6) AS ori FROM {GRADIENT}""")
def _(spark, d):
    return texture.window_texture(cells01(spark, d), tiles(spark, d), SIZE, STRIDE, PS).select("tile_id", "win_y", "win_x", "y", "x", *r6("mag", "ori"))


@query("SCL-05", """SELECT tile_id, y, x, ROUND(CASE WHEN hi = lo THEN 0 ELSE (score - lo) / (hi - lo) END, 6) AS heat,
    ROUND(greatest(1e-6, least(1 - 1e-6, (score - lo) / (hi - lo + 1e-8))), 6) AS prob FROM
    (SELECT *, MIN(score) OVER (PARTITION BY tile_id) AS lo, MAX(score) OVER (PARTITION BY tile_id) AS hi FROM dense)""")
def _(spark, d):
    c = dense(spark, d)
    span = c.groupBy("tile_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    lo, hi, s = F.col("lo"), F.col("hi"), F.col("score")
    heat = F.when(hi == lo, 0.0).otherwise((s - lo) / F.nullif(hi - lo, F.lit(0.0)))
    return c.join(span, "tile_id").select(*CELL, F.round(heat, 6).alias("heat"), F.round(scores.clip01((s - lo) / (hi - lo + 1e-8)), 6).alias("prob"))


@query("SCL-06", "SELECT tile_id, y, x, ROUND(-p * ln(p) - (1 - p) * ln(1 - p), 6) AS entropy FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, score)) AS p FROM dense)")
def _(spark, d):
    return dense(spark, d).select(*CELL, F.round(scores.entropy(F.col("score")), 6).alias("entropy"))


@query("SCL-07", """SELECT COALESCE(a.tile_id, b.tile_id) AS tile_id, COALESCE(a.y, b.y) AS y, COALESCE(a.x, b.x) AS x, ROUND(abs(a.score - b.score), 6) AS diff
    FROM cells a FULL JOIN (SELECT c.tile_id, c.y, c.x, c.score FROM ctx c WHERE buffer) b ON a.tile_id = b.tile_id AND a.y = b.y AND a.x = b.x""")
def _(spark, d):
    from .data import cells

    a = cells(spark, d).select(*CELL, F.col("score").alias("a"))
    b = context(spark, d).filter("buffer").select(*CELL, F.col("score").alias("b"))
    return a.join(b, CELL, "full").select(*CELL, F.round(F.abs(F.col("a") - F.col("b")), 6).alias("diff"))


@query("SCL-08", """SELECT tile_id, y, x, ROUND(CASE WHEN buffer THEN greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-(score - 0.5) / CAST(0.15 AS DOUBLE))))) ELSE 1e-6 END, 6) AS fg FROM ctx""")
def _(spark, d):
    return context(spark, d).select(*CELL, F.round(scores.logistic(F.col("score"), 0.5, 0.15, F.col("buffer")), 6).alias("fg"))


@query("SCL-09", """WITH m AS MATERIALIZED (SELECT tile_id, y, x, score, buffer FROM ctx), seed AS MATERIALIZED (SELECT tile_id, y, x FROM m WHERE score >= 0.6 AND buffer),
    wide AS MATERIALIZED (SELECT DISTINCT tile_id, y + dy AS y, x + dx AS x FROM seed, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) k(dy, dx))
    SELECT c.tile_id, c.y, c.x, ROUND(CASE WHEN NOT buffer THEN 1e-6 WHEN s.y IS NOT NULL THEN 0.98 WHEN w.y IS NOT NULL THEN 0.5 ELSE 0.02 END::DOUBLE, 6) AS fg,
    CASE WHEN s.y IS NOT NULL THEN 'seed' WHEN w.y IS NOT NULL THEN 'ring' ELSE 'rest' END AS part FROM m c
    LEFT JOIN seed s ON s.tile_id = c.tile_id AND s.y = c.y AND s.x = c.x LEFT JOIN wide w ON w.tile_id = c.tile_id AND w.y = c.y AND w.x = c.x""")
def _(spark, d):
    ctx = context(spark, d)
    seed = ctx.filter("score >= 0.6 and buffer").select(*CELL)
    wide = dilate(seed, tiles(spark, d), 1)
    both = (ctx.join(seed.withColumn("seed", F.lit(True)), CELL, "left").join(wide.withColumn("wide", F.lit(True)), CELL, "left").fillna(False, ["seed", "wide"]))
    s, w = F.col("seed"), F.col("wide")
    return both.select(*CELL, F.round(scores.trimap(s, w, F.col("buffer")), 6).alias("fg"), F.when(s, "seed").when(w, "ring").otherwise("rest").alias("part"))


@query("SCL-10", "SELECT tile_id, y, x, ROUND(CASE WHEN road THEN score * CAST(0.8 AS DOUBLE) ELSE score END, 6) AS score FROM ctx")
def _(spark, d):
    return context(spark, d).select(*CELL, F.round(scores.penalise(F.col("score"), F.col("road"), 0.8), 6).alias("score"))


PRIOR = "least(greatest(CASE WHEN label THEN score * CAST(1.2 AS DOUBLE) ELSE score * CAST(0.5 AS DOUBLE) END, 0), 1)"


@query("SCL-11", f"SELECT tile_id, y, x, ROUND({PRIOR}, 6) AS score FROM ctx")
def _(spark, d):
    return context(spark, d).select(*CELL, F.round(scores.prior(F.col("score"), F.col("label"), 1.2, 0.5, 1.0), 6).alias("score"))


@query("SCL-12", f"SELECT tile_id, label, COUNT(*) AS n, ROUND(AVG(score), 6) AS before, ROUND(AVG({PRIOR}), 6) AS after FROM ctx GROUP BY 1, 2")
def _(spark, d):
    after = scores.prior(F.col("score"), F.col("label"), 1.2, 0.5, 1.0)
    return context(spark, d).groupBy("tile_id", "label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("before"), F.round(F.avg(after), 6).alias("after"))


@query("SCL-13", "SELECT tile_id, y, x FROM ctx WHERE buffer AND (r * 0.5 + g * 0.8 + b * 1.0 >= 150 OR score >= 0.6)")
def _(spark, d):
    keep = scores.bright_enough((0.5, 0.8, 1.0), 150.0, F.col("r"), F.col("g"), F.col("b"), F.col("score"), 0.6)
    return context(spark, d).filter(F.col("buffer") & keep).select(*CELL)


@query("SCL-14", """SELECT path, regexp_extract(path, '([^/]*)$', 1) AS image_id, tile_id AS run FROM part_catalog UNION ALL
    SELECT path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.tif$', ''), NULL FROM tiles""")
def _(spark, d):
    runs = F.concat(F.lit("out/run_"), F.lpad(F.col("tile_id").cast("string"), 3, "0"))
    a = part_catalog(spark, d).select("path", scores.image_id(F.col("path")).alias("image_id"), scores.run_number(
        F.concat(F.lit("out/run_"), F.col("tile_id").cast("string"))).alias("run"))
    return a.unionByName(tiles(spark, d).select("path", scores.image_id(F.col("path")).alias("image_id"), scores.run_number(F.col("path")).alias("run")))


@query("SCL-16", "SELECT p_partkey, ROUND(least(20, 10 + greatest(p_retailprice / 100 - 3, 0)), 6) AS width FROM part")
def _(spark, d):
    w = scores.allowed_width(F.col("p_retailprice") / 100.0, 10.0, 3.0, 1.0, 20.0)
    return table(spark, d, "part").select("p_partkey", F.round(w, 6).alias("width"))


@query("SCL-18", """SELECT 'and' AS op, tile_id, y, x FROM ctx WHERE label AND gt UNION ALL SELECT 'or', tile_id, y, x FROM ctx WHERE label OR gt
    UNION ALL SELECT 'minus', tile_id, y, x FROM ctx WHERE label AND NOT gt UNION ALL SELECT 'xor', tile_id, y, x FROM ctx WHERE label <> gt""")
def _(spark, d):
    a, b = mask(spark, d, "label"), mask(spark, d, "gt")
    out = None
    from ..operators import algebra

    for op, fn in (("and", algebra.mask_and), ("or", algebra.mask_or), ("minus", algebra.mask_minus), ("xor", algebra.mask_xor)):
        part = fn(a, b).select(F.lit(op).alias("op"), *CELL)
        out = part if out is None else out.unionByName(part)
    return out

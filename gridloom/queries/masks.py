"""Tiling, augmentation, focal and morphology queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color
from ..operators import components, focal, tiling
from .data import (PS, SIZE, STRIDE, buffer, cells, context, dense, grid_patches, mask, placed, placed01, query, r6, shape_sql, tiles)


@query("TIL-01", """SELECT c.tile_id, win_y, win_x, COUNT(*) AS n, CAST(SUM(r) AS BIGINT) AS sum_r FROM cells c JOIN wins w ON w.tile_id = c.tile_id
    AND y >= win_y AND y < win_y + 16 AND x >= win_x AND x < win_x + 16 GROUP BY 1, 2, 3""")
def _(spark, d):
    out = tiling.assign_windows(cells(spark, d), SIZE, STRIDE)
    return out.groupBy("tile_id", "win_y", "win_x").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("sum_r"))


@query("TIL-02", "SELECT tile_id, win_y, win_x, COUNT(*) AS n, MAX(y) AS max_y, MAX(x) AS max_x FROM placed GROUP BY 1, 2, 3")
def _(spark, d):
    w = tiling.with_window_size(tiling.assign_windows(dense(spark, d), SIZE, STRIDE), tiles(spark, d), SIZE)
    return tiling.crop_to_patches(w, PS).groupBy("tile_id", "win_y", "win_x").agg(
        F.count(F.lit(1)).alias("n"), F.max("y").alias("max_y"), F.max("x").alias("max_x"))


@query("TIL-03", "SELECT tile_id, win_y, win_x, py, px, CAST(SUM(r) AS BIGINT) AS sum_r FROM placed GROUP BY 1, 2, 3, 4, 5")
def _(spark, d):
    out = tiling.patch_sums(cells(spark, d), tiles(spark, d), ["r"], SIZE, STRIDE, PS)
    return out.select("tile_id", "win_y", "win_x", "py", "px", F.col("r").alias("sum_r"))


@query("TIL-04", """SELECT p.tile_id, win_y, win_x, py, px, ROUND(COUNT(m.y) / CAST(16 AS DOUBLE), 6) AS share,
    CASE WHEN COUNT(m.y) / CAST(16 AS DOUBLE) >= 0.1 THEN 'pos' WHEN COUNT(m.y) = 0 THEN 'neg' END AS kind
    FROM placed p LEFT JOIN label_mask m ON m.tile_id = p.tile_id AND m.y = p.y AND m.x = p.x GROUP BY 1, 2, 3, 4, 5""")
def _(spark, d):
    out = tiling.mask_patch_labels(mask(spark, d, "label"), tiles(spark, d), SIZE, STRIDE, PS, 0.1)
    return out.select("tile_id", "win_y", "win_x", "py", "px", *r6("share"), "kind")


@query("TIL-05", """SELECT c.tile_id, 'img' || c.tile_id || CASE m WHEN 'orig' THEN '' ELSE '_' || m END AS image_id, r,
    CAST(CASE m WHEN 'orig' THEN y WHEN 'flip_lr' THEN y WHEN 'flip_ud' THEN height - 1 - y WHEN 'rot90' THEN width - 1 - x WHEN 'rot180' THEN height - 1 - y ELSE x END AS INT) AS y,
    CAST(CASE m WHEN 'orig' THEN x WHEN 'flip_lr' THEN width - 1 - x WHEN 'flip_ud' THEN x WHEN 'rot90' THEN y WHEN 'rot180' THEN width - 1 - x ELSE height - 1 - y END AS INT) AS x
    FROM cells c JOIN tiles t ON t.tile_id = c.tile_id, (VALUES ('orig'), ('flip_lr'), ('flip_ud'), ('rot90'), ('rot180'), ('rot270')) v(m)""")
def _(spark, d):
    img = cells(spark, d).withColumn("image_id", F.concat(F.lit("img"), F.col("tile_id").cast("string")))
    out = tiling.augment(img, tiles(spark, d), ["orig", "flip_lr", "flip_ud", "rot90", "rot45", "rot180", "rot270", "rot90"])
    return tiling.image_ids(out).select("tile_id", "image_id", "r", "y", "x")


REFLECT = "CASE WHEN {e} < 0 THEN -1 - ({e}) WHEN {e} >= {n} THEN 2 * {n} - 1 - ({e}) ELSE {e} END"


@query("NBR-01", f"""SELECT a.tile_id, a.y, a.x, ROUND(SUM(b.score * (dy * 3 + dx + 9)), 6) AS v FROM dense a
    CROSS JOIN (VALUES (-2, 0), (0, -1), (1, 2), (0, 3)) o(dy, dx) JOIN dense b ON b.tile_id = a.tile_id
    AND b.y = {REFLECT.format(e='a.y + dy', n='a.height')} AND b.x = {REFLECT.format(e='a.x + dx', n='a.width')} GROUP BY 1, 2, 3""")
def _(spark, d):
    out = focal.focal(dense(spark, d), tiles(spark, d), [(-2, 0), (0, -1), (1, 2), (0, 3)], "score", "reflect")
    return out.groupBy("tile_id", "y", "x").agg(F.round(F.sum(F.col("score") * (F.col("dy") * 3 + F.col("dx") + 9)), 6).alias("v"))


@query("NBR-02", "SELECT tile_id, y, x FROM buffer_mask")
def _(spark, d):
    return buffer(spark, d)


@query("NBR-03", """SELECT m.tile_id, m.y, m.x FROM label_mask m WHERE NOT EXISTS (SELECT 1 FROM disk JOIN grid g1 ON g1.tile_id = m.tile_id AND g1.y = m.y + dy AND g1.x = m.x + dx
    WHERE dy * dy + dx * dx <= 1 AND NOT EXISTS (SELECT 1 FROM label_mask n WHERE n.tile_id = g1.tile_id AND n.y = g1.y AND n.x = g1.x))""")
def _(spark, d):
    return focal.erode(mask(spark, d, "label"), tiles(spark, d), 1)


@query("NBR-04", f"""SELECT a.tile_id, a.y, a.x FROM grid a CROSS JOIN (SELECT CAST(p AS INT) AS dy, CAST(q AS INT) AS dx FROM unnest(range(-1, 2)) u(p), unnest(range(-1, 2)) v(q)) o
    JOIN (SELECT tile_id, y, x FROM dense WHERE score >= 0.5) b ON b.tile_id = a.tile_id AND b.y = {REFLECT.format(e='a.y + dy', n='a.height')}
    AND b.x = {REFLECT.format(e='a.x + dx', n='a.width')} GROUP BY 1, 2, 3 HAVING COUNT(*) >= 5""")
def _(spark, d):
    return focal.median3(cells(spark, d).filter("score >= 0.5"), tiles(spark, d))


@query("NBR-05", """WITH bg AS (SELECT tile_id, y, x, height, width FROM grid ANTI JOIN label_mask USING (tile_id, y, x)),
    o AS (SELECT tile_id, y, x FROM bg WHERE y = 0 OR x = 0 OR y = height - 1 OR x = width - 1 UNION
    SELECT n.tile_id, n.y, n.x FROM o CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) s(dy, dx) JOIN bg n ON n.tile_id = o.tile_id AND n.y = o.y + dy AND n.x = o.x + dx)
    SELECT tile_id, y, x, false AS filled FROM label_mask UNION ALL SELECT tile_id, y, x, true FROM bg ANTI JOIN o USING (tile_id, y, x)""")
def _(spark, d):
    return components.fill_holes(mask(spark, d, "label"))


@query("NBR-06", """WITH s AS (SELECT tile_id, MAX(py) + 1 AS hp, MAX(px) + 1 AS wp FROM grid_patches GROUP BY 1),
    t AS (SELECT g.tile_id, g.py, g.px, i, AVG(b.vec[i]) AS v FROM grid_patches g JOIN s ON s.tile_id = g.tile_id
    CROSS JOIN (SELECT CAST(p AS INT) AS dy, CAST(q AS INT) AS dx FROM unnest(range(-1, 2)) u(p), unnest(range(-1, 2)) v(q)) o
    JOIN grid_patches b ON b.tile_id = g.tile_id AND b.py = CASE WHEN g.py + dy < 0 THEN 0 WHEN g.py + dy >= hp THEN hp - 1 ELSE g.py + dy END
    AND b.px = CASE WHEN g.px + dx < 0 THEN 0 WHEN g.px + dx >= wp THEN wp - 1 ELSE g.px + dx END CROSS JOIN unnest(range(1, 65)) r(i) GROUP BY 1, 2, 3, 4)
    SELECT tile_id, py, px, CAST(i - 1 AS INT) AS dim, ROUND(v / (SQRT(SUM(v * v) OVER (PARTITION BY tile_id, py, px)) + 1e-8), 6) AS v FROM t""")
def _(spark, d):
    out = focal.local_mean(grid_patches(spark, d), 1)
    return out.select("tile_id", "py", "px", F.posexplode("vec").alias("dim", "v")).select("tile_id", "py", "px", "dim", *r6("v"))


@query("NBR-07", "SELECT tile_id, y, x, comp FROM comp8")
def _(spark, d):
    return components.components(mask(spark, d, "label"), 2)


def objects(spark, d):
    return components.rooted_cells(mask(spark, d, "label"), 2)


KEY = ["tile_id", "root"]


def root():
    """Root id as row * 1000 + column, the form of the SQL."""
    return (F.shiftright("root", 31) * 1000 + F.col("root").bitwiseAND((1 << 31) - 1)).alias("root")


@query("NBR-08", "SELECT tile_id, comp, MIN(y) AS y0, MAX(y) AS y1, MIN(x) AS x0, MAX(x) AS x1 FROM comp8 GROUP BY 1, 2")
def _(spark, d):
    return components.bboxes(components.components(mask(spark, d, "label"), 2), ["tile_id", "comp"])


@query("NBR-09", """SELECT tile_id, CAST(root AS BIGINT) AS root, y, x FROM rooted8 c WHERE (SELECT COUNT(*) FROM rooted8 n WHERE n.tile_id = c.tile_id AND n.root = c.root
    AND abs(n.y - c.y) + abs(n.x - c.x) = 1) < 4""")
def _(spark, d):
    return focal.inner_boundary(objects(spark, d), KEY).select("tile_id", root(), "y", "x")


@query("NBR-10", """WITH b AS (SELECT tile_id, root, MIN(y) AS y0, MAX(y) AS y1, MIN(x) AS x0, MAX(x) AS x1, COUNT(*) AS n FROM rooted8 GROUP BY 1, 2),
    p AS (SELECT *, CASE WHEN n = (y1 - y0 + 1) * (x1 - x0 + 1) THEN 1 ELSE 0 END AS pad FROM b),
    bg AS (SELECT tile_id, root, CAST(yy AS INT) AS y, CAST(xx AS INT) AS x FROM p, unnest(range(y0 - pad, y1 + pad + 1)) u(yy), unnest(range(x0 - pad, x1 + pad + 1)) v(xx)
    WHERE NOT EXISTS (SELECT 1 FROM rooted8 c WHERE c.tile_id = p.tile_id AND c.root = p.root AND c.y = yy AND c.x = xx))
    SELECT c.tile_id, CAST(c.root AS BIGINT) AS root, c.y, c.x, ROUND(MIN(SQRT(CAST((c.y - bg.y) * (c.y - bg.y) + (c.x - bg.x) * (c.x - bg.x) AS DOUBLE))), 6) AS dist
    FROM rooted8 c JOIN bg ON bg.tile_id = c.tile_id AND bg.root = c.root GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    comp = objects(spark, d)
    return components.distance_to_background(comp, comp, KEY).select("tile_id", root(), "y", "x", *r6("dist"))


@query("NBR-11", f"""WITH {shape_sql("(SELECT tile_id, CAST(root AS BIGINT) AS root, y, x FROM rooted8)", ["tile_id", "root"])} SELECT tile_id, root, y, x FROM thin
    UNION ALL SELECT -1, -1, -1, -1 FROM unfinished""")
def _(spark, d):
    return components.skeleton(objects(spark, d), KEY).select("tile_id", root(), "y", "x")


GRADIENT = """(SELECT tile_id, win_y, win_x, y, x, py, px, CASE WHEN n IS NULL THEN s - gray WHEN s IS NULL THEN gray - n ELSE (s - n) / 2 END AS gy,
    CASE WHEN w IS NULL THEN e - gray WHEN e IS NULL THEN gray - w ELSE (e - w) / 2 END AS gx FROM
    (SELECT *, lag(gray) OVER (PARTITION BY tile_id, win_y, win_x, x ORDER BY y) AS n, lead(gray) OVER (PARTITION BY tile_id, win_y, win_x, x ORDER BY y) AS s,
    lag(gray) OVER (PARTITION BY tile_id, win_y, win_x, y ORDER BY x) AS w, lead(gray) OVER (PARTITION BY tile_id, win_y, win_x, y ORDER BY x) AS e
    FROM (SELECT *, r * CAST(0.2989 AS DOUBLE) + g * CAST(0.5870 AS DOUBLE) + b * CAST(0.1140 AS DOUBLE) AS gray FROM placed01)))"""
LBP = """(SELECT c.tile_id, c.win_y, c.win_x, c.py, c.px, c.y, c.x, CAST(SUM(CASE WHEN n.gray >= c.gray THEN w ELSE 0 END) AS INT) AS code FROM
    (SELECT *, r * CAST(0.2989 AS DOUBLE) + g * CAST(0.5870 AS DOUBLE) + b * CAST(0.1140 AS DOUBLE) AS gray FROM placed01) c
    CROSS JOIN (VALUES (-1, -1, 1), (-1, 0, 2), (-1, 1, 4), (0, 1, 8), (1, 1, 16), (1, 0, 32), (1, -1, 64), (0, -1, 128)) o(dy, dx, w) JOIN
    (SELECT *, r * CAST(0.2989 AS DOUBLE) + g * CAST(0.5870 AS DOUBLE) + b * CAST(0.1140 AS DOUBLE) AS gray FROM placed01) n
    ON n.tile_id = c.tile_id AND n.win_y = c.win_y AND n.win_x = c.win_x AND n.y = c.y + dy AND n.x = c.x + dx GROUP BY ALL HAVING COUNT(*) = 8)"""


@query("NBR-12", f"SELECT tile_id, win_y, win_x, y, x, ROUND(gy, 6) AS gy, ROUND(gx, 6) AS gx FROM {GRADIENT}")
def _(spark, d):
    g = placed01(spark, d).withColumn("gray", color.gray(F.col("r"), F.col("g"), F.col("b")))
    return focal.gradient(g, "gray").select("tile_id", "win_y", "win_x", "y", "x", *r6("gy", "gx"))


@query("NBR-13", f"SELECT tile_id, win_y, win_x, y, x, code FROM {LBP}")
def _(spark, d):
    g = placed01(spark, d).withColumn("gray", color.gray(F.col("r"), F.col("g"), F.col("b")))
    return focal.lbp(g, "gray").select("tile_id", "win_y", "win_x", "y", "x", "code")


@query("NBR-14", """WITH edge AS (SELECT m.tile_id, m.y, m.x FROM gt_mask m WHERE (SELECT COUNT(*) FROM gt_mask n WHERE n.tile_id = m.tile_id AND abs(n.y - m.y) + abs(n.x - m.x) = 1) < 4)
    SELECT c.tile_id, c.y, c.x, CASE WHEN gt THEN 'fn' ELSE 'fp' END AS kind FROM ctx c WHERE (score >= 0.5) <> gt
    AND EXISTS (SELECT 1 FROM edge e WHERE e.tile_id = c.tile_id AND abs(e.y - c.y) + abs(e.x - c.x) <= 2)""")
def _(spark, d):
    ctx = context(spark, d)
    return focal.boundary_band_errors(ctx.filter("score >= 0.5"), mask(spark, d, "gt"), tiles(spark, d), 2)

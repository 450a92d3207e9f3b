"""Projections of the shared tables onto rasters, shapes, catalogs and logs, as DataFrames and as SQL.

Every row of a table is used: a supplier is a tile, line items are its cells, parts are its label and ground-truth shapes,
events are spans, embeddings are patch vectors. So the work of every query grows with the tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.focal import dilate
from ..operators.spatial import tile_context
from ..operators.tiling import dense_cells, patches
from ..sources.readers import rectangle_rings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SIZE, STRIDE, PS = 16, 8, 4
RADIUS = 2
THRESHOLDS = [(i + 1) / 20 for i in range(19)]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tiles(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        s.cast("int").alias("tile_id"), F.concat(F.lit("d/tile_"), F.lpad(s.cast("string"), 6, "0"), F.lit(".tif")).alias("path"),
        F.lit(32).alias("height"), (30 + s % 3).cast("int").alias("width"), F.lit(1.0).alias("px"),
        ((s % 10) * 24).cast("double").alias("left"), (F.floor(s / 10) * -24).cast("double").alias("top"),
        F.lit("EPSG:3857").alias("crs"), F.lit(0.0).alias("rot_b"), F.lit(0.0).alias("rot_d"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy(
        F.col("l_suppkey").cast("int").alias("tile_id"), (F.col("l_orderkey") % 32).cast("int").alias("y"),
        (F.col("l_partkey") % (30 + F.col("l_suppkey") % 3)).cast("int").alias("x"),
    ).agg(
        F.max(F.col("l_quantity").cast("int") * 5).alias("r"), F.max(F.round(F.col("l_discount") * 2500).cast("int")).alias("g"),
        F.max(F.round(F.col("l_tax") * 3000).cast("int")).alias("b"),
        ((F.sum(F.col("l_quantity").cast("bigint") * 37 + F.col("l_linenumber") * 11) % 1000).cast("double") / F.lit(1000.0)).alias("score"))


def cells01(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).withColumns({c: F.col(c) / F.lit(255.0) for c in "rgb"})


def dense(spark: SparkSession, d: str) -> DataFrame:
    """Every cell of every tile, missing ones 0."""
    grid = dense_cells(tiles(spark, d))
    return grid.join(cells(spark, d), ["tile_id", "y", "x"], "left").fillna(0, ["r", "g", "b"]).fillna(0.0, ["score"])


def rects(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles in tile cells: a label per part, ground truth for the larger parts, a road per supplier."""
    p, k, z = table(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    base = p.select(k.alias("geom_id"), F.greatest(F.floor(k / 20), F.lit(1)).cast("int").alias("tile_id"), (k * 7 % 32).cast("int").alias("x0"),
                    (k * 13 % 32).cast("int").alias("y0"), (1 + z % 5).cast("int").alias("w"), (1 + z * 3 % 4).cast("int").alias("h"), z.alias("size"))
    cols = ["geom_id", "tile_id", "x0", "y0", "w", "h"]
    label = base.select(F.lit("label").alias("layer"), *cols)
    gt = base.filter("size > 25").withColumn("x0", F.col("x0") + 1).withColumn("y0", F.col("y0") + 1).select(F.lit("gt").alias("layer"), *cols)
    s = F.col("s_suppkey")
    road = table(spark, d, "supplier").select(
        F.lit("road").alias("layer"), s.alias("geom_id"), s.cast("int").alias("tile_id"), F.lit(0).alias("x0"),
        (s * 11 % 32).cast("int").alias("y0"), F.lit(32).alias("w"), F.lit(1).alias("h"))
    return label.unionByName(gt).unionByName(road)


def mask(spark: SparkSession, d: str, layer: str) -> DataFrame:
    r = rects(spark, d).filter(F.col("layer") == layer).join(tiles(spark, d).select("tile_id", "height", "width"), "tile_id")
    rows = r.withColumn("y", F.explode(F.expr("sequence(y0, y0 + h - 1)"))).filter("y < height")
    return rows.withColumn("x", F.explode(F.expr("sequence(x0, x0 + w - 1)"))).filter("x < width").select("tile_id", "y", "x").distinct()


def buffer(spark: SparkSession, d: str) -> DataFrame:
    return dilate(mask(spark, d, "label"), tiles(spark, d), RADIUS)


def context(spark: SparkSession, d: str) -> DataFrame:
    """Dense context with masks and a score that favours the ground truth."""
    ctx = tile_context(cells(spark, d), mask(spark, d, "label"), mask(spark, d, "gt"), buffer(spark, d), mask(spark, d, "road"), tiles(spark, d))
    s = F.col("score")
    return ctx.withColumn("score", F.when(F.col("gt"), 0.5 + s / 2.0).otherwise(s * 0.7))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """The score of `context` where it is not 0: on image cells and on ground truth."""
    both = cells(spark, d).select("tile_id", "y", "x", "score").join(mask(spark, d, "gt").withColumn("gt", F.lit(True)), ["tile_id", "y", "x"], "full")
    s = F.coalesce("score", F.lit(0.0))
    return both.select("tile_id", "y", "x", F.when(F.col("gt"), 0.5 + s / 2.0).otherwise(s * 0.7).alias("score"))


def geoms(spark: SparkSession, d: str) -> DataFrame:
    """The rectangles in world coordinates, shifted by a quarter cell so that no side lies on a cell border."""
    r, t = rects(spark, d), F.col("tile_id")
    left, top = (t % 10) * 24, F.floor(t / 10) * -24
    x, y = left + F.col("x0") + 0.25, top - F.col("y0") - 0.25
    return r.select("layer", "geom_id", "tile_id", rectangle_rings(x, y - F.col("h"), x + F.col("w"), y).alias("rings"))


def triangles(spark: SparkSession, d: str) -> DataFrame:
    """A right triangle per part in world coordinates."""
    r, t = rects(spark, d).filter("layer = 'label'"), F.col("tile_id")
    left, top = (t % 10) * 24, F.floor(t / 10) * -24
    x, y = left + F.col("x0") + 0.125, top - F.col("y0") - 0.375

    def pt(a, b):
        return F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))

    ring = F.array(pt(x, y), pt(x + 2 * F.col("w"), y - F.col("h")), pt(x, y - 2 * F.col("h")))
    return r.select("layer", "geom_id", F.array(ring).alias("rings"))


def placed(spark: SparkSession, d: str) -> DataFrame:
    """Dense cells in windows and patches."""
    return patches(dense(spark, d), tiles(spark, d), SIZE, STRIDE, PS)


def placed01(spark: SparkSession, d: str) -> DataFrame:
    out = placed(spark, d)
    for c in "rgb":
        out = out.withColumn(c, F.col(c) / F.lit(255.0))
    return out


def spans(spark: SparkSession, d: str, *more: str) -> DataFrame:
    e, i = table(spark, d, "events"), F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.when(i % 97 == 0, "summary").when(i % 10 == 0, "timer").otherwise("span").alias("kind"),
        F.when(i % 4 == 0, F.lit(None)).when(i % 4 == 1, "validation").otherwise("holdout_inference").alias("phase"),
        F.col("event_type").alias("stage"), F.when(k < 20, F.lit(None)).otherwise(F.concat(F.lit("s"), (k % 5).cast("string"))).alias("substage"),
        F.when(i % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("tile_"), F.col("user_id").cast("string"))).alias("tile"),
        F.concat(F.lit("run_"), (F.col("user_id") % 4).cast("string")).alias("run_id"), F.col("value").alias("duration_s"), *more)


def part_catalog(spark: SparkSession, d: str) -> DataFrame:
    """A second, larger tile catalog: one tile per part."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("tile_id"), F.concat(F.lit("d/tile_"), F.lpad(k.cast("string"), 6, "0")).alias("path"),
        ((k % 50) * 10).cast("double").alias("left"), (F.floor(k / 50) * -10).cast("double").alias("top"),
        F.lit(10).alias("height"), F.lit(10).alias("width"), F.lit(1.0).alias("px"))


def done_log(spark: SparkSession, d: str) -> DataFrame:
    """One record per line item; large quantities count as done."""
    k = F.col("l_partkey")
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("d/tile_"), F.lpad(k.cast("string"), 6, "0")).alias("tile_path"),
        F.when(F.col("l_quantity") >= 48, "done").otherwise("failed").alias("status"))


def vecs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")


def grid_patches(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings laid out as one 5-wide patch grid per image of 25 patches."""
    i = F.col("vec_id")
    return table(spark, d, "embeddings").select(
        F.floor(i / 25).cast("int").alias("tile_id"), F.lit(0).alias("win_y"), F.lit(0).alias("win_x"),
        F.floor(i % 25 / 5).cast("int").alias("py"), (i % 5).cast("int").alias("px"), F.col("embedding").alias("vec"), F.col("label"))


# Common table expressions with the same content, for DuckDB.
CTES: dict[str, str] = {
    "tiles": """SELECT CAST(s_suppkey AS INT) AS tile_id, 'd/tile_' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.tif' AS path, 32 AS height,
        CAST(30 + s_suppkey % 3 AS INT) AS width, CAST(1 AS DOUBLE) AS px, CAST(s_suppkey % 10 * 24 AS DOUBLE) AS "left",
        CAST(s_suppkey // 10 * -24 AS DOUBLE) AS top FROM supplier""",
    "cells": """SELECT CAST(l_suppkey AS INT) AS tile_id, CAST(l_orderkey % 32 AS INT) AS y, CAST(l_partkey % (30 + l_suppkey % 3) AS INT) AS x,
        MAX(CAST(l_quantity AS INT) * 5) AS r, MAX(CAST(ROUND(l_discount * 2500) AS INT)) AS g, MAX(CAST(ROUND(l_tax * 3000) AS INT)) AS b,
        CAST(SUM(CAST(l_quantity AS BIGINT) * 37 + l_linenumber * 11) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score FROM lineitem GROUP BY 1, 2, 3""",
    "grid": """SELECT tile_id, CAST(yy AS INT) AS y, CAST(xx AS INT) AS x, height, width FROM tiles, unnest(range(32)) a(yy), unnest(range(32)) b(xx)
        WHERE yy < height AND xx < width""",
    "dense": """SELECT g1.tile_id, g1.y, g1.x, COALESCE(r, 0) AS r, COALESCE(g, 0) AS g, COALESCE(b, 0) AS b, COALESCE(score, 0) AS score, height, width
        FROM grid g1 LEFT JOIN cells c ON c.tile_id = g1.tile_id AND c.y = g1.y AND c.x = g1.x""",
    "rects": """SELECT 'label' AS layer, p_partkey AS geom_id, CAST(greatest(p_partkey // 20, 1) AS INT) AS tile_id, CAST(p_partkey * 7 % 32 AS INT) AS x0,
        CAST(p_partkey * 13 % 32 AS INT) AS y0, 1 + p_size % 5 AS w, 1 + p_size * 3 % 4 AS h FROM part
        UNION ALL SELECT 'gt', p_partkey, CAST(greatest(p_partkey // 20, 1) AS INT), CAST(p_partkey * 7 % 32 + 1 AS INT), CAST(p_partkey * 13 % 32 + 1 AS INT),
        1 + p_size % 5, 1 + p_size * 3 % 4 FROM part WHERE p_size > 25
        UNION ALL SELECT 'road', s_suppkey, CAST(s_suppkey AS INT), 0, CAST(s_suppkey * 11 % 32 AS INT), 32, 1 FROM supplier""",
    "burnt": """SELECT DISTINCT layer, g1.tile_id, g1.y, g1.x FROM rects r JOIN grid g1 ON g1.tile_id = r.tile_id
        AND g1.y >= y0 AND g1.y < y0 + h AND g1.x >= x0 AND g1.x < x0 + w""",
    "label_mask": "SELECT tile_id, y, x FROM burnt WHERE layer = 'label'",
    "gt_mask": "SELECT tile_id, y, x FROM burnt WHERE layer = 'gt'",
    "road_mask": "SELECT tile_id, y, x FROM burnt WHERE layer = 'road'",
    "disk": """SELECT CAST(a AS INT) AS dy, CAST(b AS INT) AS dx FROM unnest(range(-2, 3)) u(a), unnest(range(-2, 3)) v(b) WHERE a * a + b * b <= 4""",
    "buffer_mask": """SELECT DISTINCT g1.tile_id, g1.y, g1.x FROM label_mask m CROSS JOIN disk JOIN grid g1
        ON g1.tile_id = m.tile_id AND g1.y = m.y + dy AND g1.x = m.x + dx""",
    "ctx": """SELECT d.tile_id, d.y, d.x, d.r, d.g, d.b, CASE WHEN q.tile_id IS NOT NULL THEN CAST(0.5 AS DOUBLE) + d.score / 2 ELSE d.score * CAST(0.7 AS DOUBLE) END AS score,
        l.tile_id IS NOT NULL AS label, q.tile_id IS NOT NULL AS gt, f.tile_id IS NOT NULL AS buffer, o.tile_id IS NOT NULL AS road,
        q.tile_id IS NOT NULL AND f.tile_id IS NOT NULL AS gt_eval, height, width FROM dense d
        LEFT JOIN label_mask l ON l.tile_id = d.tile_id AND l.y = d.y AND l.x = d.x
        LEFT JOIN gt_mask q ON q.tile_id = d.tile_id AND q.y = d.y AND q.x = d.x
        LEFT JOIN buffer_mask f ON f.tile_id = d.tile_id AND f.y = d.y AND f.x = d.x
        LEFT JOIN road_mask o ON o.tile_id = d.tile_id AND o.y = d.y AND o.x = d.x""",
    "wins": """SELECT tile_id, CAST(a AS INT) AS win_y, CAST(b AS INT) AS win_x, CAST(least(16, height - a) AS INT) AS h_eff, CAST(least(16, width - b) AS INT) AS w_eff
        FROM tiles, unnest(range(0, 32, 8)) u(a), unnest(range(0, 32, 8)) v(b) WHERE a < height AND b < width""",
    "placed": """SELECT d.tile_id, win_y, win_x, h_eff, w_eff, d.y, d.x, d.r, d.g, d.b, d.score, CAST((d.y - win_y) // 4 AS INT) AS py, CAST((d.x - win_x) // 4 AS INT) AS px
        FROM dense d JOIN wins w ON w.tile_id = d.tile_id AND d.y >= win_y AND d.y < win_y + h_eff // 4 * 4 AND d.x >= win_x AND d.x < win_x + w_eff // 4 * 4""",
    "placed01": """SELECT tile_id, win_y, win_x, h_eff, w_eff, y, x, py, px, CAST(r AS DOUBLE) / 255 AS r, CAST(g AS DOUBLE) / 255 AS g, CAST(b AS DOUBLE) / 255 AS b FROM placed""",
    "spans": """SELECT CASE WHEN event_id % 97 = 0 THEN 'summary' WHEN event_id % 10 = 0 THEN 'timer' ELSE 'span' END AS kind,
        CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'validation' ELSE 'holdout_inference' END AS phase, event_type AS stage,
        CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) < 20 THEN NULL ELSE 's' || (CAST(json_extract_string(props, '$.k') AS INT) % 5) END AS substage,
        CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'tile_' || user_id END AS tile, 'run_' || (user_id % 4) AS run_id, value AS duration_s FROM events""",
    "part_catalog": """SELECT p_partkey AS tile_id, 'd/tile_' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS path, CAST(p_partkey % 50 * 10 AS DOUBLE) AS "left",
        CAST(p_partkey // 50 * -10 AS DOUBLE) AS top, 10 AS height, 10 AS width FROM part""",
    "done_log": """SELECT 'd/tile_' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') AS tile_path, CASE WHEN l_quantity >= 48 THEN 'done' ELSE 'failed' END AS status FROM lineitem""",
    "vecs": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings",
    "grid_patches": """SELECT CAST(vec_id // 25 AS INT) AS tile_id, CAST(vec_id % 25 // 5 AS INT) AS py, CAST(vec_id % 5 AS INT) AS px, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings""",
    # objects of the label mask: corner-connected, from the cells that no earlier neighbour precedes
    "masks3": """SELECT 0 AS m, tile_id, y, x FROM label_mask UNION ALL SELECT 1, tile_id, y, x FROM gt_mask UNION ALL SELECT 2, tile_id, y, x FROM road_mask""",
    "seeds4": """SELECT m.m, m.tile_id, m.y, m.x FROM masks3 m WHERE NOT EXISTS (SELECT 1 FROM masks3 n WHERE n.m = m.m AND n.tile_id = m.tile_id
        AND ((n.y = m.y AND n.x = m.x - 1) OR (n.y = m.y - 1 AND n.x = m.x)))""",
    "reach4": """SELECT m, tile_id, y AS sy, x AS sx, y, x FROM seeds4 UNION SELECT p.m, p.tile_id, p.sy, p.sx, n.y, n.x FROM reach4 p
        CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dy, dx) JOIN masks3 n ON n.m = p.m AND n.tile_id = p.tile_id AND n.y = p.y + o.dy AND n.x = p.x + o.dx""",
    "rooted4": "SELECT m, tile_id, y, x, MIN(sy * 1000 + sx) AS root FROM reach4 GROUP BY ALL",
    "offsets": """SELECT tile_id, CAST(tile_id // 10 * 24 AS INT) AS row_off, CAST(tile_id % 10 * 24 AS INT) AS col_off FROM tiles""",
    "seeds8": """SELECT m.tile_id, m.y, m.x FROM label_mask m WHERE NOT EXISTS (SELECT 1 FROM label_mask n WHERE n.tile_id = m.tile_id
        AND ((n.y = m.y AND n.x = m.x - 1) OR (n.y = m.y - 1 AND n.x = m.x - 1) OR (n.y = m.y - 1 AND n.x = m.x) OR (n.y = m.y - 1 AND n.x = m.x + 1)))""",
    "reach8": """SELECT tile_id, y AS sy, x AS sx, y, x FROM seeds8 UNION SELECT p.tile_id, p.sy, p.sx, n.y, n.x FROM reach8 p
        CROSS JOIN (SELECT CAST(a AS INT) AS dy, CAST(b AS INT) AS dx FROM unnest(range(-1, 2)) u(a), unnest(range(-1, 2)) v(b) WHERE a <> 0 OR b <> 0) o
        JOIN label_mask n ON n.tile_id = p.tile_id AND n.y = p.y + o.dy AND n.x = p.x + o.dx""",
    "rooted8": "SELECT tile_id, y, x, MIN(sy * 1000 + sx) AS root FROM reach8 GROUP BY 1, 2, 3",
    "comp8": "SELECT tile_id, y, x, dense_rank() OVER (PARTITION BY tile_id ORDER BY root) AS comp FROM rooted8",
}
RECURSIVE = {"reach8"}


def with_ctes(body: str) -> str:
    """Prefix a query by the expressions it names, in dependency order."""
    order: list[str] = []

    def visit(text: str, own: str | None = None) -> None:
        for name in re.findall(r"[a-z_0-9]+", text):
            if name in CTES and name != own and name not in order:
                visit(CTES[name], name)
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    body = body.strip()
    extra = ""
    if body.upper().startswith("WITH "):
        extra, body = ", " + re.sub(r"^WITH (RECURSIVE )?", "", body), ""
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in order)
    return f"WITH RECURSIVE {head}{extra} {body}".strip()


def shape_sql(cells: str, key: list[str], rounds: int = 14) -> str:
    """CTEs for objects of `cells` (key, y, x): thinning unrolled to `rounds` rounds (`thin`, and `unfinished` with a row if the last one still removed cells), distances to the
    background of an object's box (`far`) and the shape measures (`shape`)."""
    k, same = ", ".join(key), lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in key)
    ring = " ".join(f"WHEN {dy * 3 + dx} THEN {1 << i}" for i, (dy, dx) in enumerate([(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]))
    ctes = [f"z0 AS MATERIALIZED (SELECT {k}, y, x FROM {cells})"]
    for i in range(2 * rounds):
        rule = "(b & 1 > 0 AND b & 4 > 0 AND b & 64 > 0) OR (b & 1 > 0 AND b & 16 > 0 AND b & 64 > 0)" if i % 2 else "(b & 1 > 0 AND b & 4 > 0 AND b & 16 > 0) OR (b & 4 > 0 AND b & 16 > 0 AND b & 64 > 0)"
        ctes.append(f"""z{i + 1} AS MATERIALIZED (SELECT {k}, y, x FROM (SELECT {', '.join(f'c.{x}' for x in key)}, c.y, c.x, CAST(SUM(CASE (n.y - c.y) * 3 + n.x - c.x {ring} ELSE 0 END) AS INT) AS b
            FROM z{i} c JOIN z{i} n ON {same('c', 'n')} AND n.y BETWEEN c.y - 1 AND c.y + 1 AND n.x BETWEEN c.x - 1 AND c.x + 1 GROUP BY ALL)
            WHERE NOT (bit_count(b) BETWEEN 2 AND 6 AND bit_count(b & ~((b << 1) | (b >> 7)) & 255) = 1 AND NOT ({rule})))""")
    ctes.append(f"thin AS (SELECT * FROM z{2 * rounds})")
    ctes.append(f"unfinished AS (SELECT 1 WHERE (SELECT COUNT(*) FROM z{2 * rounds - 2}) <> (SELECT COUNT(*) FROM z{2 * rounds}))")
    ctes.append(f"""boxes AS (SELECT *, CASE WHEN n = (y1 - y0 + 1) * (x1 - x0 + 1) THEN 1 ELSE 0 END AS pad FROM
        (SELECT {k}, MIN(y) AS y0, MAX(y) AS y1, MIN(x) AS x0, MAX(x) AS x1, COUNT(*) AS n FROM z0 GROUP BY ALL))""")
    ctes.append(f"""empty AS MATERIALIZED (SELECT {', '.join(f'p.{x}' for x in key)}, CAST(yy AS INT) AS y, CAST(xx AS INT) AS x FROM boxes p, unnest(range(y0 - pad, y1 + pad + 1)) u(yy), unnest(range(x0 - pad, x1 + pad + 1)) v(xx)
        WHERE NOT EXISTS (SELECT 1 FROM z0 c WHERE {same('c', 'p')} AND c.y = yy AND c.x = xx))""")
    ctes.append(f"""far AS (SELECT {', '.join(f't.{x}' for x in key)}, t.y, t.x, MIN(SQRT(CAST((t.y - e.y) * (t.y - e.y) + (t.x - e.x) * (t.x - e.x) AS DOUBLE))) AS d FROM thin t JOIN empty e ON {same('t', 'e')} GROUP BY ALL)""")
    ctes.append(f"""edge AS (SELECT {k}, COUNT(*) AS p FROM z0 c WHERE (SELECT COUNT(*) FROM z0 n WHERE {same('n', 'c')} AND abs(n.y - c.y) + abs(n.x - c.x) = 1) < 4 GROUP BY ALL)""")
    ctes.append(f"""shape AS (SELECT {', '.join(f'b.{x}' for x in key)}, CAST(coalesce(e.p, 0) AS DOUBLE) AS perimeter_px, CAST(4 * pi() * b.n / (coalesce(e.p, 0) * coalesce(e.p, 0) + 1e-8) AS DOUBLE) AS circularity,
        CAST(coalesce(t.n, 0) AS DOUBLE) AS length_px, coalesce(t.w, 0) AS mean_width_px, CAST(coalesce(t.n, 0) / greatest(coalesce(t.w, 0), 1e-6) AS DOUBLE) AS skeleton_ratio
        FROM boxes b LEFT JOIN edge e ON {same('e', 'b')} LEFT JOIN (SELECT {k}, COUNT(*) AS n, 2 * AVG(d) AS w FROM far GROUP BY ALL) t ON {same('t', 'b')})""")
    return ",\n".join(ctes)


def query(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_ctes(sql)
        return fn

    return keep


def r6(*names: str):
    """Rounded double columns, the precision of all comparisons."""
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]

"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import polygons, spatial, spanlog, tiling
from ..plans.scratch import new_path
from ..sources import readers, stores
from .data import (PS, SIZE, STRIDE, cells, dense, done_log, geoms, mask, part_catalog, query, r6, rects, spans, table, tiles)


@query("SRC-01", "SELECT tile_id, y, x, r, g, b FROM cells")
def _(spark, d):
    return readers.raster_cells(cells(spark, d))


@query("SRC-02", """SELECT tile_id, CAST(y * (height // 3) // height AS INT) AS y, CAST(x * (width // 3) // width AS INT) AS x,
    ROUND(AVG(r), 6) AS r, ROUND(AVG(g), 6) AS g, ROUND(AVG(b), 6) AS b FROM dense GROUP BY 1, 2, 3""")
def _(spark, d):
    return readers.downsample(dense(spark, d), tiles(spark, d), 3).select("tile_id", "y", "x", *r6("r", "g", "b"))


GRID = {"left": 0.0, "top": 0.0, "px": 2.0, "height": 1 << 30, "width": 50}


def label_raster(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.floor(k / 50).cast("int").alias("src_row"), (k % 50).cast("int").alias("src_col"), (F.col("p_size") % 3).alias("v"))


@query("SRC-03", """WITH lab AS (SELECT CAST(p_partkey // 50 AS INT) AS src_row, CAST(p_partkey % 50 AS INT) AS src_col, p_size % 3 AS v FROM part)
    SELECT g1.tile_id, g1.y, g1.x, COALESCE(v, 0) AS v FROM grid g1 JOIN tiles t ON t.tile_id = g1.tile_id
    LEFT JOIN lab ON src_row = CAST(floor(-(top - y - CAST(0.5 AS DOUBLE)) / 2) AS INT) AND src_col = CAST(floor(("left" + x + CAST(0.5 AS DOUBLE)) / 2) AS INT)""")
def _(spark, d):
    return readers.labels_on_grid(label_raster(spark, d), GRID, tiles(spark, d))


@query("SRC-04", """SELECT geom_id, CAST(4 AS INT) AS points, CAST(tile_id % 10 * 24 + x0 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS min_x FROM rects
    JOIN part ON p_partkey = geom_id WHERE layer = 'label' AND p_size % 7 <> 0""")
def _(spark, d):
    size = table(spark, d, "part").select(F.col("p_partkey").alias("geom_id"), "p_size")
    raw = geoms(spark, d).filter("layer = 'label'").join(size, "geom_id")
    some = raw.withColumn("rings", F.when(F.col("p_size") % 14 == 0, F.lit(None)).when(F.col("p_size") % 7 == 0, F.slice("rings", 1, 0)).otherwise(F.col("rings")))
    return spatial.with_bbox(readers.geometries(some)).select("geom_id", F.size(F.col("rings")[0]).alias("points"), "min_x")


@query("SRC-05", """SELECT DISTINCT CAST(l_suppkey // 16 AS INT) AS block, true AS plain, CAST(0 AS BIGINT) AS above FROM lineitem""")
def _(spark, d):
    path = new_path(spark, "tile-files")
    blocks = cells(spark, d).withColumn("block", F.expr("cast(tile_id div 16 as int)"))
    blocks.repartition("block").write.partitionBy("block").parquet(path)
    above = readers.list_tiles(spark, path, "*.parquet").agg(F.count(F.lit(1)).alias("above"))  # files of sub-folders do not count
    listed = readers.list_tiles(spark, f"{path}/block=*", "*.parquet")
    here = listed.select(F.regexp_extract("path", "block=([0-9]+)", 1).cast("int").alias("block"), F.col("path").startswith("/").alias("plain")).distinct()
    return here.crossJoin(F.broadcast(above))  # one row


def list_file(spark, d):
    path = new_path(spark, "tile-list")
    lines = part_catalog(spark, d).withColumn("value", F.explode(F.array(F.concat(F.lit("  "), "path", F.lit(" ")), F.lit("   "))))
    lines.select("value").write.text(path)
    return path


@query("SRC-06", "SELECT path FROM part_catalog")
def _(spark, d):
    return readers.read_tile_list(spark, list_file(spark, d))


@query("SRC-07", """SELECT path, 'file' AS origin FROM part_catalog UNION ALL SELECT path, 'explicit' FROM tiles WHERE path NOT LIKE '%3%' UNION ALL SELECT path, 'legacy' FROM part_catalog WHERE path NOT LIKE '%3%'""")
def _(spark, d):
    t, p = tiles(spark, d), part_catalog(spark, d)

    def keep(df):
        return df.filter(~F.col("path").like("%3%"))

    a = readers.resolve_tiles(spark, list_file(spark, d), explicit=t, legacy=p, label_filter=keep)
    return a.unionByName(readers.resolve_tiles(spark, explicit=t, legacy=p, label_filter=keep)).unionByName(readers.resolve_tiles(spark, legacy=p, label_filter=keep))


@query("SRC-08", """SELECT event_id::VARCHAR AS image_id, event_type AS stage, 'span' AS kind, CASE WHEN user_id % 9 = 0 THEN CAST(0 AS DOUBLE) ELSE value END AS duration_s,
    CASE WHEN user_id % 5 = 0 THEN 0 ELSE 1 END AS extras FROM events WHERE event_type <> 'error'""")
def _(spark, d):
    u = F.col("user_id")
    good = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("image_id"), F.col("event_type").alias("stage"), F.lit("span").alias("kind"),
        F.when(u % 9 != 0, F.col("value").cast("string")).alias("duration_s"), F.when(u % 5 != 0, F.create_map(F.lit("k"), F.col("props"))).alias("extra")))
    line = F.when(F.col("event_type") != "error", good).when(u % 2 == 0, F.substring(good, 1, 20)).otherwise(F.lit("[1, 2]"))
    return readers.parse_spans(table(spark, d, "events").select(line.alias("value"))).select(
        "image_id", "stage", "kind", "duration_s", F.size("extra").alias("extras"))


@query("SRC-09", "SELECT DISTINCT tile_path FROM done_log WHERE status = 'done'")
def _(spark, d):
    return readers.finished(done_log(spark, d))


def mosaic_parts(spark, d):
    t = tiles(spark, d)
    offsets = spatial.mosaic_offsets(t, spatial.mosaic_profile(t))
    return [spatial.place_on_mosaic(mask(spark, d, layer), offsets, "raw") for layer in ("label", "gt")]


def grown_mosaic(spark, d):
    path = new_path(spark, "union")
    for part in mosaic_parts(spark, d):
        stores.append_union(part, path)
    return path


UNION = """SELECT DISTINCT 'raw' AS variant, CAST(y + row_off AS INT) AS gy, CAST(x + col_off AS INT) AS gx, 1 AS v
    FROM (SELECT * FROM label_mask UNION ALL SELECT * FROM gt_mask) m JOIN offsets o ON o.tile_id = m.tile_id"""


@query("SNK-01", UNION)
def _(spark, d):
    return stores.read_mosaic(spark, grown_mosaic(spark, d)).select("variant", "gy", "gx", "v")


@query("SNK-03", UNION)
def _(spark, d):
    path, backup = grown_mosaic(spark, d), new_path(spark, "backup")
    written = [stores.backup_union(path, backup, step, 10, spark) for step in (9, 10)]
    return stores.read_mosaic(spark, written[1]).select("variant", "gy", "gx", "v")


@query("SNK-04", """SELECT CAST(dense_rank() OVER (ORDER BY tile_id, root) - 1 AS BIGINT) AS geom_id, tile_id, CAST(n AS DOUBLE) AS area
    FROM (SELECT tile_id, root, COUNT(*) AS n FROM rooted4 WHERE m = 0 GROUP BY 1, 2)""")
def _(spark, d):
    v = polygons.mask_polygons(mask(spark, d, "label"), tiles(spark, d))
    return polygons.polygon_areas(v, ["tile_id"]).select("geom_id", "tile_id", "area")


@query("SNK-05", """SELECT CAST(dense_rank() OVER (ORDER BY m, tile_id, root) - 1 AS BIGINT) AS geom_id, m, tile_id, CAST(n AS DOUBLE) AS area
    FROM (SELECT m, tile_id, root, COUNT(*) AS n FROM rooted4 GROUP BY 1, 2, 3)""")
def _(spark, d):
    masks = None
    for i, layer in enumerate(("label", "gt", "road")):
        part = mask(spark, d, layer).withColumn("m", F.lit(i))
        masks = part if masks is None else masks.unionByName(part)
    t = tiles(spark, d).withColumn("m", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    v = polygons.mask_polygons(masks, t, ["m", "tile_id"])
    return polygons.polygon_areas(v, ["m", "tile_id"]).select("geom_id", "m", "tile_id", "area")


def appended(spark, d):
    path, next_id = new_path(spark, "polygons"), 1000
    for layer in ("label", "gt", "none"):
        rows = rects(spark, d).filter(F.col("layer") == layer).withColumnRenamed("geom_id", "source_id").select("layer", "source_id", "tile_id")
        next_id = stores.append_polygons(rows, path, next_id, [F.col("source_id")])
    return path


@query("SNK-06", """SELECT 999 + row_number() OVER (ORDER BY layer = 'gt', geom_id) AS geom_id, layer, geom_id AS source_id, tile_id FROM rects WHERE layer <> 'road'""")
def _(spark, d):
    return spark.read.parquet(appended(spark, d)).select("geom_id", "layer", "source_id", "tile_id")


@query("SNK-07", "SELECT COUNT(*) AS n, CAST(0 AS BIGINT) AS missing FROM rects WHERE layer <> 'road'")
def _(spark, d):
    path = appended(spark, d)
    n, missing = stores.count_features(spark, path), stores.count_features(spark, path + "-none")
    return spark.range(1).select(F.lit(n).cast("bigint").alias("n"), F.lit(missing).cast("bigint").alias("missing"))


def patch_store(spark, d):
    means = tiling.patch_means(cells(spark, d), tiles(spark, d), ["r"], SIZE, STRIDE, PS)
    return means.select(F.col("tile_id").alias("image_id"), "win_y", "win_x", "py", "px", F.col("r").alias("v"))


def stored(spark, d):
    """Images written in two steps under one spec, then one window of each replaced; an older spec beside it."""
    path = new_path(spark, "features")
    rows = patch_store(spark, d)
    stores.write_features(rows, path, "old", PS, 1)
    odd = F.col("image_id") % 2 == 1
    for part in (rows.filter(odd), rows.filter(~odd), rows.filter("win_y = 0 and win_x = 0").withColumn("v", F.col("v") + 1000)):
        stores.write_features(part, path, "new", PS, 1)
    return stores.read_features(spark, path)


@query("SNK-08", """SELECT tile_id AS image_id, win_y, win_x, COUNT(DISTINCT (py, px)) AS n, win_y = 0 AND win_x = 0 AS replaced FROM placed p
    WHERE w_eff // 4 = least(16, 31 - win_x) // 4 GROUP BY 1, 2, 3""")
def _(spark, d):
    narrow = tiling.windows(tiles(spark, d).withColumn("width", F.lit(31)), SIZE, STRIDE).select(
        F.col("tile_id").alias("image_id"), "win_y", "win_x", F.expr("cast(h_eff div 4 as int)").alias("hp"), F.expr("cast(w_eff div 4 as int)").alias("wp"))
    good = stores.valid_features(stored(spark, d), "new", PS, 1, narrow)
    return good.groupBy("image_id", "win_y", "win_x").agg(F.count(F.lit(1)).alias("n"), F.every(F.col("v") >= 1000).alias("replaced"))


@query("SNK-09", """SELECT tile_id AS image_id, win_y, win_x, MAX(py) + 1 AS hp, MAX(px) + 1 AS wp, (MAX(py) + 1) * 4 AS h_eff, (MAX(px) + 1) * 4 AS w_eff
    FROM placed GROUP BY 1, 2, 3""")
def _(spark, d):
    return stores.feature_manifest(patch_store(spark, d), PS)


@query("SNK-10", """SELECT tile_id AS image_id, win_y, win_x, py, px, row_number() OVER (PARTITION BY tile_id ORDER BY tile_id || '_y' || win_y || '_x' || win_x, py, px) AS n
    FROM (SELECT DISTINCT tile_id, win_y, win_x, py, px FROM placed)""")
def _(spark, d):
    return stores.consolidate(patch_store(spark, d)).select("image_id", "win_y", "win_x", "py", "px", "n")


@query("SNK-11", """SELECT CAST(vec_id AS BIGINT) AS vec_id, label, CAST(label AS BIGINT) AS image_id, CASE WHEN label % 2 = 0 THEN 'b' ELSE 'a' END AS spec_hash,
    CAST(embedding[1] AS DOUBLE) AS v_first, CAST(embedding[len(embedding)] AS DOUBLE) AS v_last, CAST(len(embedding) AS INT) AS dims FROM embeddings""")
def _(spark, d):
    """All images under spec a, image by image; then half of them under spec b, which makes their first banks stale."""
    path = new_path(spark, "bank")
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("label").cast("bigint").alias("image_id"), "embedding")
    for spec, rows in (("a", e.filter("label < 4")), ("a", e.filter("label >= 4")), ("b", e.filter("label % 2 = 0"))):
        stores.write_bank(rows.withColumn("spec_hash", F.lit(spec)).withColumn("ps", F.lit(PS)).withColumn("context", F.lit(0)).withColumn("resample", F.lit(1)), path)
    v = F.col("embedding")
    return stores.read_bank(spark, path).select("vec_id", "label", "image_id", "spec_hash", v[0].cast("double").alias("v_first"), F.element_at(v, -1).cast("double").alias("v_last"), F.size(v).alias("dims"))


@query("SNK-12", """SELECT stage, CAST(COUNT(*) AS BIGINT) AS "count", ROUND(AVG(duration_s), 6) AS mean_s, MAX(duration_s) AS max_s, ROUND(SUM(duration_s), 6) AS total_s FROM spans GROUP BY 1""")
def _(spark, d):
    path = new_path(spark, "summary")
    rows = spanlog.by_stage(spans(spark, d)).select("stage", "count", *r6("mean_s"), "max_s", *r6("total_s"))
    stores.write_summary(rows, path, ["stage", "count", "mean_s", "max_s", "total_s"])
    return spark.read.schema("stage string, count bigint, mean_s double, max_s double, total_s double").option("header", True).csv(path)

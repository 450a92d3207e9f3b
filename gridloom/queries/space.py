"""Spatial join, raster and mosaic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spatial
from .data import geoms, mask, query, r6, table, tiles, triangles

BOX = """t."left" < {x1} AND t."left" + t.width > {x0} AND t.top > {y0} AND t.top - t.height < {y1}"""


@query("SPA-01", """SELECT DISTINCT layer, g1.tile_id, g1.y, g1.x FROM (SELECT layer, tile_id % 10 * 24 + x0 + 0.25 AS a0, tile_id % 10 * 24 + x0 + w + 0.25 AS a1,
    tile_id // 10 * -24 - y0 - h - 0.25 AS b0, tile_id // 10 * -24 - y0 - 0.25 AS b1 FROM rects WHERE layer <> 'road') r
    JOIN tiles t ON t."left" < a1 AND t."left" + t.width > a0 AND t.top > b0 AND t.top - t.height < b1
    JOIN grid g1 ON g1.tile_id = t.tile_id AND t."left" + g1.x < a1 AND t."left" + g1.x + 1 > a0 AND t.top - g1.y > b0 AND t.top - g1.y - 1 < b1""")
def _(spark, d):
    g = geoms(spark, d).filter("layer <> 'road'").drop("tile_id")
    return spatial.rasterize(g, tiles(spark, d), True, 32.0)


TRI = """(SELECT p_partkey AS geom_id, greatest(p_partkey // 20, 1) % 10 * 24 + p_partkey * 7 % 32 + 0.125 AS ax, greatest(p_partkey // 20, 1) // 10 * -24 - p_partkey * 13 % 32 - 0.375 AS ay,
    1 + p_size % 5 AS w, 1 + p_size * 3 % 4 AS h FROM part)"""


@query("SPA-02", f"""WITH e AS (SELECT geom_id, ax, ay, w, h, UNNEST([{{'x0': ax, 'y0': ay, 'x1': ax + 2 * w, 'y1': ay - h}}, {{'x0': ax + 2 * w, 'y0': ay - h, 'x1': ax, 'y1': ay - 2 * h}},
    {{'x0': ax, 'y0': ay - 2 * h, 'x1': ax, 'y1': ay}}]) AS e FROM {TRI})
    SELECT DISTINCT layer, tile_id, y, x FROM (SELECT 'label' AS layer, g1.tile_id, g1.y, g1.x, e.geom_id FROM e JOIN tiles t ON t."left" < ax + 2 * w AND t."left" + t.width > ax AND t.top > ay - 2 * h
    AND t.top - t.height < ay JOIN grid g1 ON g1.tile_id = t.tile_id WHERE (e.e.y0 > t.top - g1.y - 0.5) <> (e.e.y1 > t.top - g1.y - 0.5)
    AND t."left" + g1.x + 0.5 < e.e.x0 + (t.top - g1.y - 0.5 - e.e.y0) * (e.e.x1 - e.e.x0) / (e.e.y1 - e.e.y0) GROUP BY 1, 2, 3, 4, 5 HAVING COUNT(*) % 2 = 1)""")
def _(spark, d):
    return spatial.rasterize(triangles(spark, d), tiles(spark, d), False, 32.0)


@query("SPA-03", """SELECT layer, geom_id, t.tile_id FROM (SELECT layer, geom_id, tile_id % 10 * 24 + x0 + 0.25 AS a0, tile_id % 10 * 24 + x0 + w + 0.25 AS a1,
    tile_id // 10 * -24 - y0 - h - 0.25 AS b0, tile_id // 10 * -24 - y0 - 0.25 AS b1 FROM rects) r
    JOIN tiles t ON t."left" <= a1 AND t."left" + t.width >= a0 AND t.top >= b0 AND t.top - t.height <= b1""")
def _(spark, d):
    return spatial.spatial_join(geoms(spark, d).drop("tile_id"), tiles(spark, d), 32.0).select("layer", "geom_id", "tile_id")


def _holed(spark, d):
    """Each label rectangle as a hole of one that is a cell wider on every side."""
    raw = geoms(spark, d).filter("layer = 'label'").drop("tile_id")
    wider = F.transform(F.col("rings")[0], lambda p: F.struct(
        F.when(p["x"] == F.array_min(F.transform(F.col("rings")[0], lambda q: q["x"])), p["x"] - 1.0).otherwise(p["x"] + 1.0).alias("x"),
        F.when(p["y"] == F.array_min(F.transform(F.col("rings")[0], lambda q: q["y"])), p["y"] - 1.0).otherwise(p["y"] + 1.0).alias("y")))
    return raw.select(F.lit("holed").alias("layer"), "geom_id", F.array(wider, F.col("rings")[0]).alias("rings"))


def _clipped(a0, a1, b0, b1):
    return f"""greatest(0, least({a1}, t."left" + t.width) - greatest({a0}, t."left")) * greatest(0, least({b1}, t.top) - greatest({b0}, t.top - t.height))"""


@query("SPA-04", f"""SELECT CASE WHEN u.holed THEN 'holed' ELSE layer END AS layer, geom_id, t.tile_id,
    ROUND(CAST(CASE WHEN u.holed THEN {_clipped('a0 - 1', 'a1 + 1', 'b0 - 1', 'b1 + 1')} - {_clipped('a0', 'a1', 'b0', 'b1')} ELSE {_clipped('a0', 'a1', 'b0', 'b1')} END AS DOUBLE), 6) AS area
    FROM (SELECT layer, geom_id, tile_id % 10 * 24 + x0 + 0.25 AS a0, tile_id % 10 * 24 + x0 + w + 0.25 AS a1,
    tile_id // 10 * -24 - y0 - h - 0.25 AS b0, tile_id // 10 * -24 - y0 - 0.25 AS b1 FROM rects) r
    CROSS JOIN (SELECT unnest([false, true]) AS holed) u
    JOIN tiles t ON (NOT u.holed OR layer = 'label') AND {_clipped('a0 - u.holed::INT', 'a1 + u.holed::INT', 'b0 - u.holed::INT', 'b1 + u.holed::INT')} > 0""")
def _(spark, d):
    every = geoms(spark, d).drop("tile_id").select("layer", "geom_id", "rings").unionByName(_holed(spark, d))
    clipped = spatial.clip_to_tiles(every, tiles(spark, d), 32.0)
    return clipped.select("layer", "geom_id", "tile_id", F.round(spatial.ring_area_sum(F.col("rings")), 6).alias("area"))


@query("SPA-05", """SELECT t.tile_id, CAST(a AS INT) AS y, CAST(b AS INT) AS x FROM tiles t, unnest(range(20)) u(a), unnest(range(50)) v(b)
    WHERE EXISTS (SELECT 1 FROM label_mask m WHERE m.tile_id = t.tile_id AND m.y = (2 * a + 1) * height // 40 AND m.x = (2 * b + 1) * width // 100)""")
def _(spark, d):
    return spatial.resize_nearest(mask(spark, d, "label"), tiles(spark, d), 20, 50)


@query("SPA-06", """SELECT t.tile_id, CAST(a AS INT) AS y, CAST(b AS INT) AS x FROM tiles t, unnest(range(64)) u(a), unnest(range(64)) v(b) WHERE a < ceil(t.height / 0.75) AND b < ceil(t.width / 0.75)
    AND EXISTS (SELECT 1 FROM rects r WHERE layer = 'road' AND "left" + (b + 0.5) * 0.75 > tile_id % 10 * 24 + 0.25 AND "left" + (b + 0.5) * 0.75 < tile_id % 10 * 24 + 32.25
    AND top - (a + 0.5) * 0.75 < tile_id // 10 * -24 - y0 - 0.25 AND top - (a + 0.5) * 0.75 > tile_id // 10 * -24 - y0 - 1.25)""")
def _(spark, d):
    bounds = tiles(spark, d).select("tile_id", "left", "top", (F.col("left") + F.col("width")).alias("right"), (F.col("top") - F.col("height")).alias("bottom"))
    roads = geoms(spark, d).filter("layer = 'road'").drop("tile_id")
    return spatial.build_raster(roads, bounds, 0.75, 32.0).select("tile_id", "y", "x")


@query("SPA-07", """SELECT p_partkey, ROUND(lon * 6378137.0 * pi() / 180, 4) AS mx, ROUND(ln(tan(pi() / 4 + lat * pi() / 360)) * 6378137.0, 4) AS my, ROUND(lon, 6) AS lon, ROUND(lat, 6) AS lat
    FROM (SELECT p_partkey, CAST(p_partkey % 360 - 180 AS DOUBLE) AS lon, CAST(p_size * 3 - 80 AS DOUBLE) AS lat FROM part)""")
def _(spark, d):
    pts = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 360 - 180).cast("double").alias("lon"), (F.col("p_size") * 3 - 80).cast("double").alias("lat"))
    there = spatial.reproject(pts, "lon", "lat", "EPSG:4326", "EPSG:3857").withColumn("mx", F.round("lon", 4)).withColumn("my", F.round("lat", 4))
    return spatial.reproject(there, "lon", "lat", "EPSG:3857", "EPSG:4326").select("p_partkey", "mx", "my", *r6("lon", "lat"))


@query("SPA-08", """SELECT t.tile_id, CASE WHEN width = 31 THEN 'offset' END AS reason, pw AS width, ph AS height FROM tiles t, (SELECT
    CAST(MAX(CASE WHEN width = 31 THEN "left" + 0.5 ELSE "left" END + width) - MIN(CASE WHEN width = 31 THEN "left" + 0.5 ELSE "left" END) AS INT) AS pw, CAST(MAX(top) - MIN(top - height) AS INT) AS ph FROM tiles)""")
def _(spark, d):
    t = tiles(spark, d).withColumn("left", F.when(F.col("width") == 31, F.col("left") + 0.5).otherwise(F.col("left")))
    profile = spatial.mosaic_profile(t)
    bad = spatial.mosaic_violations(t, profile)
    return t.select("tile_id").join(bad, "tile_id", "left").join(F.broadcast(profile.select("width", "height")))


@query("SPA-09", """SELECT field FROM (VALUES ('width'), ('left')) v(field) WHERE (SELECT COUNT(*) FROM tiles) > 0""")
def _(spark, d):
    t = tiles(spark, d)
    a = spatial.mosaic_profile(t)
    b = a.withColumn("width", F.col("width") + 1).withColumn("left", F.col("left") - 1.0).withColumn("top", F.col("top") + 1e-12)
    return spatial.profile_mismatches(a, b)


@query("SPA-10", "SELECT tile_id, row_off, col_off, true AS fits FROM offsets")
def _(spark, d):
    t = tiles(spark, d)
    return spatial.mosaic_offsets(t, spatial.mosaic_profile(t)).select("tile_id", "row_off", "col_off", "fits")


@query("SPA-11", """SELECT DISTINCT layer AS variant, CAST(y + row_off AS INT) AS gy, CAST(x + col_off AS INT) AS gx, 1 AS v FROM burnt m JOIN offsets o ON o.tile_id = m.tile_id""")
def _(spark, d):
    """Two shards of tiles, merged per variant."""
    t = tiles(spark, d)
    offsets = spatial.mosaic_offsets(t, spatial.mosaic_profile(t))
    shards = None
    for layer in ("label", "gt", "road"):
        part = spatial.place_on_mosaic(mask(spark, d, layer), offsets, layer)
        shards = part if shards is None else shards.unionByName(part)
    return spatial.merge_mosaics(shards)


@query("SPA-12", "SELECT tile_id, y, x, r, g, b, label, gt, buffer, road, gt_eval FROM ctx")
def _(spark, d):
    from .data import context

    return context(spark, d).drop("score")


@query("SPA-12-buffer", "SELECT p_partkey, CAST(round_even(CAST(p_size AS DOUBLE) / 2, 0) AS INT) AS buffer_px FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", spatial.buffer_cells(F.col("p_size").cast("double"), F.lit(2.0)).alias("buffer_px"))


@query("SPA-13", """SELECT tile_id, COUNT(*) AS cells, CAST(SUM(label::INT) AS BIGINT) AS label_cells, CAST(SUM(gt::INT) AS BIGINT) AS gt_cells, CAST(SUM(buffer::INT) AS BIGINT) AS buffer_cells,
    CAST(SUM(road::INT) AS BIGINT) AS road_cells, ROUND(AVG(label::INT), 6) AS label_ratio, ROUND(AVG(buffer::INT), 6) AS buffer_ratio, ROUND(AVG(road::INT), 6) AS road_ratio,
    CAST(MAX(height) // 4 * (MAX(width) // 4) AS BIGINT) AS patch_rows FROM ctx GROUP BY 1""")
def _(spark, d):
    from .data import context

    out = spatial.workload(context(spark, d), tiles(spark, d), 4)
    return out.select("tile_id", "cells", "label_cells", "gt_cells", "buffer_cells", "road_cells", *r6("label_ratio", "buffer_ratio", "road_ratio"), "patch_rows")

from __future__ import annotations

import numpy as np
import pytest
from helpers import blobs, grid_of, label_components, mask_df, tiles
from pyspark.sql import functions as F

from gridloom.operators import catalog, polygons, spatial
from gridloom.plans.scratch import new_path
from gridloom.sources import readers, stores


def geom_df(spark, *rings, layer="road"):
    rows = [(layer, i, [[{"x": float(x), "y": float(y)} for x, y in ring]]) for i, ring in enumerate(rings)]
    return spark.createDataFrame(rows, "layer string, geom_id int, rings array<array<struct<x:double,y:double>>>")


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_clip_box_literal(spark):
    t, g = tiles(spark, (4, 4)), geom_df(spark, box(-100, -100, 2, 6))
    m = grid_of(spatial.rasterize(g, t, False, 8.0), (4, 4))
    assert m[:, :2].all() and not m[:, 2:].any()
    clipped = spatial.clip_to_tiles(g, t, 8.0)
    assert clipped.select(spatial.ring_area_sum(F.col("rings"))).first()[0] == 8.0


def inside(ring, x, y):
    hit = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        if (y0 > y) != (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0):
            hit = not hit
    return hit


@pytest.mark.parametrize("seed", range(3))
def test_polygons_burn_by_centre_and_by_touch(spark, seed):
    rng = np.random.default_rng(seed)
    t = tiles(spark, (12, 15))
    ring = [(7 + r * np.cos(a) + .013, 6 + r * np.sin(a) + .017) for a, r in zip(np.sort(rng.random(7) * 6.28), 1 + 6 * rng.random(7))]
    centre = grid_of(spatial.rasterize(geom_df(spark, ring), t, False, 5.0), (12, 15))
    touched = grid_of(spatial.rasterize(geom_df(spark, ring), t, True, 5.0), (12, 15))
    fine = np.linspace(0, 1, 400)
    edge = np.zeros((12, 15), bool)
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        for s in fine:
            y, x = int(np.floor(12 - (y0 + s * (y1 - y0)))), int(np.floor(x0 + s * (x1 - x0)))
            if 0 <= y < 12 and 0 <= x < 15:
                edge[y, x] = True
    want = np.array([[inside(ring, x + .5, 12 - y - .5) for x in range(15)] for y in range(12)])
    assert (centre == want).all()
    assert not ((edge | want) & ~touched).any()  # sampled edges are a subset of the touched cells
    assert (touched & ~(edge | want)).sum() <= 3


def test_hole_by_even_odd(spark):
    rows = [("gt", 0, [[{"x": float(x), "y": float(y)} for x, y in r] for r in (box(0, 0, 8, 8), box(2, 2, 6, 6))])]
    g = spark.createDataFrame(rows, "layer string, geom_id int, rings array<array<struct<x:double,y:double>>>")
    assert spatial.rasterize(g, tiles(spark, (8, 8)), False, 4.0).count() == 64 - 16


def test_geometry_in_several_buckets_pairs_once(spark):
    g = geom_df(spark, box(1, 1, 90, 90), box(50, 50, 51, 51))
    pairs = spatial.spatial_join(g, tiles(spark, (100, 100)), 7.0)
    assert sorted(r["geom_id"] for r in pairs.collect()) == [0, 1]
    assert spatial.spatial_join(geom_df(spark, [(101, 101), (120, 101), (110, 130)]), tiles(spark, (100, 100)), 7.0).count() == 0


@pytest.mark.parametrize("seed", [2, 3])
def test_polygon_rings_cover_their_objects(spark, seed):
    g = blobs(seed, 20, 18, .55)
    labels = label_components(g, 1)
    v = polygons.mask_polygons(mask_df(spark, g), tiles(spark, (20, 18))).cache()
    areas = {r["geom_id"]: r["area"] for r in polygons.polygon_areas(v).collect()}
    assert areas == {k - 1: float((labels == k).sum()) for k in range(1, labels.max() + 1)}
    seen = v.groupBy("geom_id").agg(F.countDistinct(F.when(F.col("is_outer"), F.col("ring"))).alias("outer")).collect()
    assert all(r["outer"] == 1 for r in seen)
    # consecutive corners share one coordinate
    for _, ring in v.toPandas().groupby(["geom_id", "ring"]):
        pts = list(ring.sort_values("seq")[["wx", "wy"]].itertuples(index=False, name=None))
        assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(pts, pts[1:] + pts[:1]))


def adjacent(spark):
    return spark.createDataFrame([(0, 2, 2, 0.0, 2.0, 1.0, "EPSG:3857", 0.0, 0.0), (1, 2, 2, 2.0, 2.0, 1.0, "EPSG:3857", 0.0, 0.0)],
                                 "tile_id int, height int, width int, left double, top double, px double, crs string, rot_b double, rot_d double")


def test_union_of_adjacent_tiles(spark):
    t = adjacent(spark)
    offsets = spatial.mosaic_offsets(t, spatial.mosaic_profile(t))
    m = mask_df(spark, [[1, 0], [0, 0]], [[0, 1], [0, 0]])
    path = new_path(spark, "union")
    for _ in range(2):  # repeating changes nothing
        for tile in (0, 1):
            stores.append_union(spatial.place_on_mosaic(m.filter(F.col("tile_id") == tile), offsets, "raw"), path)
    assert {(r["gy"], r["gx"]) for r in stores.read_mosaic(spark, path).collect()} == {(0, 0), (0, 3)}
    assert stores.read_mosaic(spark, path).count() == 2
    assert stores.read_mosaic(spark, path + "-none").count() == 0
    backup = stores.backup_union(path, path + "-b", 20, 10, spark, numbered=True)
    assert backup.endswith("step_000020") and stores.read_mosaic(spark, backup).count() == 2
    assert stores.backup_union(path, path + "-b", 21, 10, spark) is None


def test_mask_must_fit_its_tile(spark):
    with pytest.raises(Exception, match="does not fit"):
        stores.check_tile_shape(mask_df(spark, np.ones((3, 1))), adjacent(spark), ["tile_id"]).collect()


def test_merge_keeps_present_variants(spark):
    rows = [("raw", "a", 0, 0), ("raw", "b", 0, 1), ("shadow_with_proposals", "a", 0, 0), ("shadow_with_proposals", "b", 0, 1)]
    df = spark.createDataFrame(rows, "variant string, shard string, gy int, gx int").withColumn("v", F.lit(1))
    assert {(r["variant"], r["gx"]) for r in spatial.merge_mosaics(df).collect()} == {(v, x) for v in ("raw", "shadow_with_proposals") for x in (0, 1)}


def test_profile_violations(spark):
    t = adjacent(spark)
    profile = spatial.mosaic_profile(t)
    bad = t.withColumn("left", F.when(F.col("tile_id") == 1, 2.5).otherwise(F.col("left")))
    assert spatial.mosaic_violations(t, profile).count() == 0
    assert {r["reason"] for r in spatial.mosaic_violations(bad, profile).collect()} == {"offset"}
    assert {r["reason"] for r in spatial.mosaic_violations(t.withColumn("rot_b", F.lit(.1)), profile).collect()} == {"rotation"}
    assert {r["reason"] for r in spatial.mosaic_violations(t.withColumn("left", F.col("left") + 9), profile).collect()} == {"bounds"}


def label_raster(spark):
    return spark.createDataFrame([(r, c, 1 if c < 10 else 0) for r in range(10) for c in range(20)], "src_row int, src_col int, v int")


def presence_tiles(spark):
    return spark.createDataFrame([(i, 10, 10, float(x), 10.0, 1.0, f"t{i}", 1, 1) for i, x in enumerate((0, 10, 25))],
                                 "tile_id int, height int, width int, left double, top double, px double, path string, mtime int, size int")


GRID = {"left": 0.0, "top": 10.0, "px": 1.0, "height": 10, "width": 20}


def test_label_presence_and_cache(spark):
    t, labels = presence_tiles(spark), label_raster(spark)
    out = {r["tile_id"]: r["keep"] for r in catalog.tiles_with_label(t, labels, GRID).collect()}
    assert out == {0: True, 1: False, 2: False}
    assert catalog.tiles_with_label(t, None).filter("keep").count() == 3
    cache = catalog.tiles_with_label(t, labels, GRID).select("path", "mtime", "size", F.lit("s").alias("raster_sig"), "keep")
    moved = t.withColumn("left", F.when(F.col("tile_id") == 0, 10.0).otherwise(F.col("left"))).withColumn("mtime", F.when(F.col("tile_id") == 0, 2).otherwise(F.col("mtime")))
    again = {r["tile_id"]: (r["keep"], r["cached"]) for r in catalog.with_cached_decisions(moved, cache, lambda m: catalog.tiles_with_label(m, labels, GRID), "s").collect()}
    assert again == {0: (False, False), 1: (False, True), 2: (False, True)}
    assert not any(r["cached"] for r in catalog.with_cached_decisions(t, cache, lambda m: catalog.tiles_with_label(m, labels, GRID), "other").collect())


def test_aligned_labels(spark):
    labels = spark.createDataFrame([(r, c, r * 8 + c) for r in range(8) for c in range(8)], "src_row int, src_col int, v int")
    t = spark.createDataFrame([(0, 2, 2, 2.0, 6.0, 2.0)], "tile_id int, height int, width int, left double, top double, px double")
    out = readers.labels_on_grid(labels, {"left": 0.0, "top": 8.0, "px": 1.0}, t)
    got = {(r["y"], r["x"]): r["v"] for r in out.collect()}
    assert got == {(y, x): (2 * y + 3) * 8 + 2 * x + 3 for y in (0, 1) for x in (0, 1)}
    far = t.withColumn("left", F.lit(100.0))
    assert {r["v"] for r in readers.labels_on_grid(labels, {"left": 0.0, "top": 8.0, "px": 1.0}, far, fill=7).collect()} == {7}


def test_labels_across_crs(spark):
    labels = spark.createDataFrame([(r, c, r * 4 + c) for r in range(4) for c in range(4)], "src_row int, src_col int, v int")
    left, right = .02 * 111319.49079327358, .42 * 111319.49079327358
    top = float(np.log(np.tan(np.pi / 4 + .98 * np.pi / 360)) * 6378137)
    t = spark.createDataFrame([(0, 4, 4, left, top, (right - left) / 4)], "tile_id int, height int, width int, left double, top double, px double")
    out = readers.labels_on_grid(labels, {"left": 0.0, "top": 1.0, "px": .1}, t, to_label=("EPSG:3857", "EPSG:4326"))
    assert {(r["y"], r["x"]): r["v"] for r in out.collect()} == {(y, x): y * 4 + x for y in range(4) for x in range(4)}
    with pytest.raises(ValueError):
        spatial.reproject(t, "left", "top", "EPSG:25832", "EPSG:4326")


def test_raster_errors(spark):
    bounds = spark.createDataFrame([(0, 0.0, 0.0, 4.0, 4.0)], "tile_id int, left double, bottom double, right double, top double")
    with pytest.raises(ValueError):
        spatial.build_raster(geom_df(spark, box(0, 0, 1, 1)), bounds, 0, 4.0)
    with pytest.raises(ValueError):
        spatial.build_raster(geom_df(spark, box(0, 0, 1, 1)).filter("geom_id > 5"), bounds, 1.0, 4.0)


def test_holes_count_against_the_area(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    hole = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]
    for rings in ([square, hole], [square, hole[::-1]], [hole, square[::-1]]):
        df = spark.createDataFrame([(rings,)], "rings array<array<struct<x: double, y: double>>>")
        assert df.select(spatial.ring_area_sum(spatial.oriented(F.col("rings")))).first()[0] == 12.0


def test_context_lays_out_rows(spark, monkeypatch):
    monkeypatch.setattr(spatial, "_LAID", 7)
    t = tiles(spark, (3, 5), (2, 4))
    image = spark.createDataFrame([(0, 0, 0, 1, 2, 3, .5), (0, 0, 0, 9, 1, 3, .25), (0, 2, 4, -7, None, 1, None), (0, 1, 9, 1, 1, 1, 1.0), (0, 8, 0, 1, 1, 1, 1.0), (5, 0, 0, 1, 1, 1, 1.0)],
                                  "tile_id int, y int, x int, r int, g int, b int, score double")
    none = mask_df(spark, np.zeros((1, 1)))
    label, gt = mask_df(spark, np.eye(3), np.ones((1, 2))), mask_df(spark, np.ones((3, 9)))
    out = {(r["tile_id"], r["y"], r["x"]): r for r in spatial.tile_context(image, label, gt, label, none, t).collect()}
    assert sorted(out) == [(0, y, x) for y in range(3) for x in range(5)] + [(1, y, x) for y in range(2) for x in range(4)]
    assert tuple(out[0, 0, 0])[3:7] == (9, 2, 3, .5) and tuple(out[0, 2, 4])[3:7] == (-7, 0, 1, 0.0) and tuple(out[1, 1, 1])[3:7] == (0, 0, 0, 0.0)
    assert {k for k, r in out.items() if r["label"]} == {(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 0), (1, 0, 1)} == {k for k, r in out.items() if r["buffer"]}
    assert all(r["gt"] == (k[0] == 0) and not r["road"] and r["gt_eval"] == (r["gt"] and r["buffer"]) for k, r in out.items())


def test_geometry_over_many_tiles_and_bands(spark):
    rows = [(i * 10 + j, 10, 10 + j % 2, float(10 * j), float(100 - 10 * i), 1.0) for i in range(4) for j in range(5)]
    t = spark.createDataFrame(rows, "tile_id int, height int, width int, left double, top double, px double")
    outer, hole, other = box(3, 62, 48, 99), box(12, 71, 29, 88), [(0, 60), (20, 80), (40, 60)]
    g = spark.createDataFrame([("a", 0, [[{"x": float(x), "y": float(y)} for x, y in r] for r in (outer, hole)]), ("b", 1, [[{"x": float(x), "y": float(y)} for x, y in other]])],
                              "layer string, geom_id int, rings array<array<struct<x:double,y:double>>>")
    cells = {(r["layer"], r["tile_id"], r["y"], r["x"]) for r in spatial.rasterize(g, t, False, 7.0).collect()}
    want = set()
    for tile, h, w, left, top, _ in rows:
        for y in range(h):
            for x in range(w):
                cx, cy = left + x + .5, top - y - .5
                if inside(outer, cx, cy) != inside(hole, cx, cy):
                    want.add(("a", tile, y, x))
                if inside(other, cx, cy):
                    want.add(("b", tile, y, x))
    assert cells == want
    met = {(r["layer"], r["tile_id"]) for r in spatial.spatial_join(g, t, 7.0).collect()}
    # a tile of this size meets a shape here exactly if it shares a cell with it or its outline touches the tile's border
    touched = {(r["layer"], r["tile_id"]) for r in spatial.rasterize(g, t, True, 7.0).select("layer", "tile_id").distinct().collect()}
    assert touched <= met and ("a", 12) in met and ("a", 11) in met and {k for k in met if k[0] == "b"} - touched <= {("b", 0), ("b", 1), ("b", 2), ("b", 3), ("b", 4), *[("b", i) for i in range(100)]}
    clipped = {(r["layer"], r["tile_id"]): r["a"] for r in spatial.clip_to_tiles(g, t.filter("width = 10"), 7.0).select("layer", "tile_id", spatial.ring_area_sum(F.col("rings")).alias("a")).collect()}
    assert clipped["a", 2] == 10 * 9.0 - 9 * 0 and sum(v for (k, _), v in clipped.items() if k == "b") > 0


@pytest.mark.parametrize("block", [3, 4, 16])
def test_rings_do_not_depend_on_blocks(spark, block):
    """Before, sides of all cells were ranked one by one over the network, whatever the block."""
    g = blobs(5, 20, 18, .55)
    g[2:19, 1] = g[18, 1:17] = g[2:19, 16] = True
    mask, t = mask_df(spark, g, np.ones((7, 9), bool)), tiles(spark, (20, 18), (7, 9))
    cols = ["geom_id", "tile_id", "ring", "is_outer", "seq", "wx", "wy"]
    one, many = ({tuple(r) for r in polygons.mask_polygons(mask, t, block=b).select(cols).collect()} for b in (256, block))
    assert one == many and len(one) > 50
    assert sorted(r[4] for r in one if r[1] == 1) == [0, 9, 16, 25]  # the full tile's corners, counted along its sides

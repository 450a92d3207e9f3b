from __future__ import annotations

import numpy as np
import pytest
from helpers import blobs, box_distance, disk_dilate, grid_of, label_components, mask_df, thin, tiles

from gridloom.operators import components, focal


@pytest.mark.parametrize("seed", [0, 1])
def test_dilate_erode_duality(spark, seed):
    g, t = blobs(seed), tiles(spark, (24, 20))
    grown = grid_of(focal.dilate(mask_df(spark, g), t, 3), g.shape)
    assert (grown == disk_dilate(g, 3)).all()
    shrunk = grid_of(focal.erode(mask_df(spark, g), t, 2), g.shape)
    assert (shrunk == ~disk_dilate(~g, 2)).all()


def test_erode_with_unset_outside(spark):
    g, t = np.ones((5, 5), bool), tiles(spark, (5, 5))
    out = grid_of(focal.erode(mask_df(spark, g), t, 1, "diamond", False), g.shape)
    assert out.sum() == 9 and out[1:4, 1:4].all()


def test_median_reflects_edges(spark):
    g = blobs(3, 9, 7)
    p = np.pad(g, 1, mode="symmetric").astype(int)
    want = sum(p[1 + a:10 + a, 1 + b:8 + b] for a in (-1, 0, 1) for b in (-1, 0, 1)) >= 5
    assert (grid_of(focal.median3(mask_df(spark, g), tiles(spark, (9, 7))), g.shape) == want).all()


@pytest.mark.parametrize("conn", [1, 2])
def test_components_match_flood_fill(spark, conn):
    a, b = blobs(5), blobs(6)
    df = components.components(mask_df(spark, a, b), conn).cache()
    for tile, g in enumerate((a, b)):
        assert (grid_of(df, g.shape, tile, "comp") == label_components(g, conn)).all()


def test_component_count_is_transpose_invariant(spark):
    g = blobs(8)
    n = [components.components(mask_df(spark, m), 2).select("comp").distinct().count() for m in (g, g.T)]
    assert n[0] == n[1] == label_components(g, 2).max()


def test_long_snake_is_one_component(spark):
    g = np.zeros((21, 15), bool)
    g[::2] = True
    g[1::4, -1] = True
    g[3::4, 0] = True
    df = components.components(mask_df(spark, g), 1)
    assert df.select("comp").distinct().count() == 1 and df.count() == g.sum()


def test_fill_holes(spark):
    g = np.ones((7, 7), bool)
    g[2:5, 2:5] = False
    out = components.fill_holes(mask_df(spark, g))
    assert grid_of(out, g.shape).all() and out.filter("filled").count() == 9


def test_holes_against_flood_fill(spark):
    g = blobs(11, 30, 30, 0.55)
    background = label_components(~g, 1)
    border = set(np.concatenate([background[0], background[-1], background[:, 0], background[:, -1]]).tolist())
    want = ~g & ~np.isin(background, list(border))
    assert (grid_of(components.holes(mask_df(spark, g)), g.shape) == want).all()


def test_distance_and_skeleton(spark):
    g = blobs(12, 26, 22, 0.6)
    labels = label_components(g, 2)
    rooted = components.rooted_cells(mask_df(spark, g), 2)
    key = ["tile_id", "root"]
    dist = grid_of(components.distance_to_background(rooted, rooted, key), g.shape, value="dist")
    thinned = grid_of(components.skeleton(rooted, key), g.shape)
    for k in range(1, labels.max() + 1):
        one = labels == k
        for (y, x), d in box_distance(one).items():
            assert dist[y, x] == pytest.approx(d)
        assert (thinned & one == thin(one)).all()


def test_full_box_measures_to_the_outside(spark):
    g = np.zeros((6, 8), bool)
    g[1:4, 2:7] = True
    rooted = components.rooted_cells(mask_df(spark, g), 2)
    out = grid_of(components.distance_to_background(rooted, rooted, ["tile_id", "root"]), g.shape, value="dist")
    assert out[2, 4] == 2.0 and out[1, 2] == 1.0


def test_band_errors(spark):
    gt, pred = np.zeros((9, 9), bool), np.zeros((9, 9), bool)
    gt[2:6, 2:6] = True
    pred[3:9, 2:6] = True
    out = {(r["y"], r["x"], r["kind"]) for r in focal.boundary_band_errors(mask_df(spark, pred), mask_df(spark, gt), tiles(spark, (9, 9)), 1).collect()}
    assert {(2, x, "fn") for x in range(2, 6)} <= out
    assert {(y, k) for y, _, k in out} == {(2, "fn"), (6, "fp")}


@pytest.mark.parametrize("r", [1, 2, 5])
def test_local_mean_is_separable(spark, r):
    rng = np.random.default_rng(r)
    m = rng.normal(size=(4, 3, 2))
    rows = [(0, w, 0, y, x, [float(v) for v in m[y, x]]) for w in (0, 16) for y in range(4) for x in range(3)]
    df = spark.createDataFrame(rows, "tile_id int, win_y int, win_x int, py int, px int, vec array<double>").repartition(5)
    pad = np.pad(m, ((20, 20), (20, 20), (0, 0)), mode="symmetric")
    for o in focal.local_mean(df, r).collect():
        y, x = o["py"] + 20, o["px"] + 20
        mean = pad[y - r:y + r + 1, x - r:x + r + 1].mean((0, 1))
        assert np.allclose(o["vec"], mean / (np.linalg.norm(mean) + 1e-8))


@pytest.mark.parametrize("kernel", ["disk", "square", "diamond"])
def test_erosion_by_events(spark, kernel):
    g, t = blobs(4, 30, 33, 0.7), tiles(spark, (30, 33))
    for r in (1, 3):
        offsets = [(dy, dx) for dy, hw in focal.half_widths(r, kernel) for dx in range(-hw, hw + 1)]
        for outside in (True, False):
            pad = np.pad(g, r, constant_values=outside)
            want = np.logical_and.reduce([pad[r + dy:r + dy + 30, r + dx:r + dx + 33] for dy, dx in offsets])
            assert (grid_of(focal.erode(mask_df(spark, g), t, r, kernel, outside), g.shape) == want).all()

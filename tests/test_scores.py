from __future__ import annotations

import numpy as np
import pytest
from helpers import dense_df, grid_of, mask_df, tiles
from pyspark.sql import functions as F

from gridloom.functions import color, scores
from gridloom.operators import focal, refine


def test_trimap_literal(spark):
    s = np.full((5, 5), .1)
    s[1:3, 1:3] = .9
    seed = s >= .5
    wide = grid_of(focal.dilate(mask_df(spark, seed), tiles(spark, (5, 5)), 1), s.shape)
    p = grid_of(dense_df(spark, {"seed": seed, "wide": wide}).withColumn("p", scores.trimap(F.col("seed"), F.col("wide"))), s.shape, value="p")
    assert p[1, 1] == pytest.approx(.98) and p[0, 0] == pytest.approx(.02) and p[0, 1] == pytest.approx(.5) and seed.sum() == 4


def test_trimap_outside_buffer(spark):
    ones, buf = np.ones((3, 3), bool), np.ones((3, 3), bool)
    buf[0, 0] = False
    p = grid_of(dense_df(spark, {"m": ones, "buffer": buf}).withColumn("p", scores.trimap(F.col("m"), F.col("m"), F.col("buffer"))), (3, 3), value="p")
    assert p[0, 0] < 1e-4 and p[1, 1] > .9


def test_prior_literal(spark):
    df = dense_df(spark, {"score": np.array([[.4, .4]]), "label": np.array([[1, 0]], bool)})
    out = [r[0] for r in df.orderBy("x").select(scores.prior(F.col("score"), F.col("label"), 1.2, 0.5, 1.0)).collect()]
    assert out == pytest.approx([.48, .2])


def test_allowed_width_literal(spark):
    df = spark.createDataFrame([(3.0,), (8.0,), (30.0,)], "p double")
    assert [r[0] for r in df.select(scores.allowed_width(F.col("p"), 10, 3, 1, 20)).collect()] == [10, 15, 20]


def test_hsv_ties_and_gray(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0), (0.5, 0.5, 0.5), (0.2, 0.6, 0.6)], "r double, g double, b double")
    h = color.hsv(F.col("r"), F.col("g"), F.col("b"))
    rows = df.select(h["h"].alias("h"), h["s"].alias("s"), h["v"].alias("v")).collect()
    assert rows[0]["h"] == 0 and rows[0]["s"] == pytest.approx(1) and rows[1]["h"] == 0 and rows[1]["s"] == 0
    assert rows[2]["h"] == pytest.approx((-1 + 4) / 6, abs=1e-6)  # blue wins over green


def test_paths(spark):
    df = spark.createDataFrame([("a/b/tile_7.x.tif", "out/run_012"), ("t", "out/other")], "p string, r string")
    rows = df.select(scores.image_id(F.col("p")).alias("i"), scores.run_number(F.col("r")).alias("n")).collect()
    assert [tuple(r) for r in rows] == [("tile_7.x", 12), ("t", None)]


def dense(spark, p, rgb=None, buffer=None):
    h, w = p.shape
    flat = np.zeros((h, w), int)
    rgb = rgb if rgb is not None else (flat, flat, flat)
    cols = {"r": rgb[0], "g": rgb[1], "b": rgb[2], "p": p}
    if buffer is not None:
        cols["buffer"] = buffer
    return dense_df(spark, cols)


def test_refine_with_zero_weights_is_the_unary(spark):
    p = np.random.default_rng(0).random((8, 8))
    out = refine.pairwise_refine(dense(spark, p), refine.PairwiseConfig(pos_w=0, bilateral_w=0, steps=2))
    assert (grid_of(out.filter("mask"), p.shape) == (p > .5)).all()


def test_refine_smooths_lonely_cells_and_stays_in_buffer(spark):
    p, buf = np.full((15, 15), .3), np.ones((15, 15), bool)
    p[7, 7] = .6
    p[:4] = .9
    buf[:, :5] = False
    cfg = refine.PairwiseConfig(pos_w=3, pos_xy_std=2, bilateral_w=2, bilateral_xy_std=5, bilateral_rgb_std=10, steps=3)
    m = grid_of(refine.pairwise_refine(dense(spark, p, buffer=buf), cfg).filter("mask"), p.shape)
    assert not m[7, 7] and m[1, 8] and not m[:, :5].any()


def test_colour_edges_hold(spark):
    """Two halves of different colour with a weak tilt each: the colour kernel keeps the border."""
    p = np.full((10, 12), .35)
    p[:, 6:] = .65
    r = np.zeros((10, 12), int)
    r[:, 6:] = 200
    cfg = refine.PairwiseConfig(pos_w=0, bilateral_w=4, bilateral_xy_std=6, bilateral_rgb_std=10, steps=3)
    m = grid_of(refine.pairwise_refine(dense(spark, p, (r, r, r)), cfg).filter("mask"), p.shape)
    assert m[:, 6:].all() and not m[:, :6].any()


@pytest.mark.parametrize("steps, block", [(2, 256), (3, 8), (3, 40)])
def test_refinement_in_blocks_equals_tables_of_vertices(spark, steps, block):
    """One block, blocks of one filter a pass, and blocks of two: all cells, whatever the cuts."""
    rng = np.random.default_rng(5)
    p, rgb = rng.random((70, 53)), [rng.integers(0, 256, (70, 53)) for _ in range(3)]
    cfg = refine.PairwiseConfig(pos_w=1, pos_xy_std=2, bilateral_w=2, bilateral_xy_std=3, bilateral_rgb_std=60, steps=steps)
    df = dense(spark, p, rgb, rng.random((70, 53)) < .9)
    want = refine._through_vertices(df.withColumn("p", scores.clip01(F.col("p"))), cfg, ["tile_id"])
    got = refine.pairwise_refine(df, cfg, block=block)
    assert np.allclose(grid_of(got, p.shape, value="p_fg"), grid_of(want, p.shape, value="p_fg"), atol=1e-9)
    assert (grid_of(got.filter("mask"), p.shape) == grid_of(want.filter("mask"), p.shape)).all() and got.count() == p.size
    assert not any(x in got._jdf.queryExecution().optimizedPlan().toString() for x in ("Join", "Aggregate"))  # only cells are shuffled

"""Threshold, median, buffer and holes in one pass over blocks."""

from __future__ import annotations

import numpy as np
import pytest
from helpers import blobs, dense_df, grid_of, label_components, mask_df, tiles
from pyspark.sql import functions as F

from gridloom.operators import components, refine


def median(g):
    pad = np.pad(g.astype(int), 1, mode="edge")
    return sum(pad[a:a + g.shape[0], b:b + g.shape[1]] for a in range(3) for b in range(3)) >= 5


def filled(g):
    back = label_components(~g, 1)
    border = set(np.concatenate([back[0], back[-1], back[:, 0], back[:, -1]]).tolist())
    return g | ~np.isin(back, list(border))


def ring(h, w):
    """A long loop around most of a tile, with an island and a loop with a mouth inside."""
    g = np.zeros((h, w), bool)
    g[2:h - 2, 2:w - 2] = True
    g[4:h - 4, 4:w - 4] = False
    g[8:20, 8:20] = True
    g[11:17, 11:17] = False
    g[h - 16:h - 7, 6:16] = True
    g[h - 13:h - 10, 9:16] = False
    g[h - 20:h, w - 6:] = False  # opens the long loop
    return g


@pytest.mark.parametrize(("block", "fill", "clip"), [(256, True, True), (5, True, True), (5, True, False), (16, True, False), (3, False, True), (70, False, False)])
def test_stream_mask_does_not_depend_on_blocks(spark, block, fill, clip):
    loop = ring(80, 90)
    loop[76:78, 80:88] = loop[58:78, 86:88] = loop[58:60, 80:88] = True  # closes it again
    grids = [blobs(1, 24, 20, .55), ring(41, 37), loop, np.ones((1, 3), bool), np.zeros((6, 5), bool), np.pad(np.ones((2, 2), bool), 60)]
    rng = np.random.default_rng(block)
    buffers = [rng.random(g.shape) < .8 for g in grids]
    df = mask_df(spark, *grids).withColumn("score", F.lit(.5)).unionByName(mask_df(spark, *[~g for g in grids]).withColumn("score", F.lit(.25)).filter("y % 2 = 0"))
    df = df.unionByName(spark.createDataFrame([(99, 0, 0, 1.0), (3, 7, 0, 1.0), (3, 0, 5, 1.0)], df.schema))  # no tile, below and beside a tile
    out = refine.stream_mask(df, F.col("score"), .5, tiles(spark, *[g.shape for g in grids]), mask_df(spark, *buffers) if clip else None, fill, block=block).cache()
    total = 0
    for k, (g, b) in enumerate(zip(grids, buffers, strict=True)):
        want = median(g) & b if clip else median(g)
        if fill:
            want = filled(want) & b if clip else filled(want)
        assert (grid_of(out, g.shape, k) == want).all()
        total += want.sum()
    assert out.count() == total


@pytest.mark.parametrize("block", [4, 7, 32, 256])
def test_holes_across_blocks(spark, block):
    grids = [blobs(11, 30, 30, 0.55), ring(50, 61), filled(ring(50, 61))]
    out = components.fill_holes(mask_df(spark, *grids), block=block).cache()
    for k, g in enumerate(grids):
        assert (grid_of(out, g.shape, k) == filled(g)).all()
        assert (grid_of(out.filter("filled"), g.shape, k) == (filled(g) & ~g)).all()
    assert out.groupBy("tile_id", "y", "x").count().filter("count > 1").isEmpty()


def test_small_tiles_need_one_pass(spark, monkeypatch):
    """Before, gaps of rows were written and linked over the network three times over, and the median was taken twice."""
    monkeypatch.setattr(components, "cut", None)
    g = ring(41, 37)
    df = dense_df(spark, {"score": g.astype(float)})
    out = refine.stream_mask(df, F.col("score"), .5, tiles(spark, g.shape), None, True)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert (grid_of(out, g.shape) == filled(median(g))).all()


def test_query_lays_out_no_dense_cells(spark, sf, monkeypatch):
    """Before, every cell of every tile was laid out and written with all its bands."""
    from gridloom.queries import QUERIES, objects

    want = {tuple(r) for r in refine.stream_mask(objects.context(spark, sf), F.col("score"), .35, objects.tiles(spark, sf), objects.buffer(spark, sf), True).collect()}
    monkeypatch.setattr(objects, "context", None)
    got = [tuple(r) for r in QUERIES["REF-02"](spark, sf).collect()]
    assert set(got) == want and len(got) == len(want) > 50

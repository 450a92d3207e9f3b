"""Texture of windows from blocks of cells: the same values as from window copies, and no sort of those."""

from __future__ import annotations

import numpy as np
import pytest

from gridloom.operators import features, texture, tiling
from gridloom.queries import QUERIES
from helpers import tiles

SHAPES = [(9, 11), (32, 30), (3, 2), (1, 40), (21, 5), (4, 4)]


@pytest.fixture(scope="module")
def scene(spark):
    """Sparse cells, nulls, cells outside their tile or of no tile; a tile without cells."""
    rng = np.random.default_rng(0)
    rows = [(t, y, x, *[float(v) / 255 if rng.random() > 0.1 else None for v in rng.integers(0, 4, 3) * 60])
            for t, (h, w) in enumerate(SHAPES[:-1]) for y in range(h) for x in range(w) if rng.random() < 0.6]
    rows += [(0, 9, 0, 1.0, 1.0, 1.0), (0, 0, 11, 1.0, 1.0, 1.0), (0, -1, 3, 1.0, 1.0, 1.0), (99, 0, 0, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "tile_id int, y int, x int, r double, g double, b double"), tiles(spark, *SHAPES)


def _copies(scene, size, stride, ps):
    cells, t = scene
    dense = tiling.dense_cells(t).join(cells, ["tile_id", "y", "x"], "left").fillna(0.0, ["r", "g", "b"])
    return features.with_texture(tiling.patches(dense, t, size, stride, ps)).cache()


def _rows(df, key, *values):
    return {tuple(r[c] for c in key): np.ravel([r[v] for v in values]) for r in df.collect()}


@pytest.mark.parametrize(("size", "stride", "ps", "block"), [(16, 8, 4, 256), (8, 4, 2, 6), (8, 4, 4, 8), (6, 3, 3, 7), (4, 8, 4, 256), (4, 4, 1, 5)])
def test_texture_of_blocks_equals_window_copies(spark, scene, size, stride, ps, block):
    old, cell, patch = _copies(scene, size, stride, ps), ["tile_id", "win_y", "win_x", "y", "x"], ["tile_id", "win_y", "win_x", "py", "px"]
    given = (*scene, size, stride, ps)
    for got, want in ((_rows(texture.window_texture(*given, block=block), cell, "mag", "ori"), _rows(old, cell, "mag", "ori")),
                      (_rows(texture.patch_gradients(*given, block=block), patch, "mag_mean", "mag_std"), _rows(features.grad_stats(old), patch, "mag_mean", "mag_std")),
                      (_rows(texture.patch_orientations(*given, 8, block=block), patch, "hist"), _rows(features.orient_hist(old, 8), patch, "hist"))):
        assert got.keys() == want.keys() and len(got) > 20
        assert max(abs(got[k] - want[k]).max() for k in want) < 1e-12
    old.unpersist()


def test_patches_across_windows_are_refused(scene):
    with pytest.raises(ValueError, match="patch"):
        texture.patch_gradients(*scene, 8, 3, 2)


@pytest.mark.parametrize("name", ["FEA-05", "FEA-06", "SCL-04"])
def test_no_window_copies_are_sorted(spark, sf, name):
    """Before, every cell was copied to its windows, and the copies were shuffled and sorted twice for their neighbours."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "lag(" not in plan

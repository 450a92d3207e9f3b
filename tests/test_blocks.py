"""Two-level labelling, envelopes and halo thinning with blocks much smaller than the objects."""

from __future__ import annotations

import numpy as np
import pytest
from helpers import blobs, box_distance, grid_of, label_components, mask_df, thin

from gridloom.operators import blocks, components


def _spiral(n):
    g, y, x, dy, dx = np.zeros((n, n), bool), 0, 0, 0, 1
    for _ in range(n * n):
        g[y, x] = True
        a, b = y + dy, x + dx
        c, d = a + dy, b + dx
        if not (0 <= a < n and 0 <= b < n) or (0 <= c < n and 0 <= d < n and g[c, d]):
            dy, dx = dx, -dy
            a, b = y + dy, x + dx
            if not (0 <= a < n and 0 <= b < n) or g[a, b] or (0 <= a + dy < n and 0 <= b + dx < n and g[a + dy, b + dx]):
                break
        y, x = a, b
    return g


GRIDS = [_spiral(23), np.eye(17, dtype=bool)[:, ::-1], np.ones((9, 30), bool), np.add.outer(np.arange(13), np.arange(21)) % 2 == 0, blobs(5, 40, 33), np.zeros((4, 4), bool)]


@pytest.mark.parametrize(("conn", "block"), [(1, 4), (2, 4), (2, 7), (1, 256), (2, 256)])
def test_labels_across_blocks(spark, conn, block):
    got = components.components(mask_df(spark, *GRIDS), conn, block=block).cache()
    for i, g in enumerate(GRIDS):
        assert (grid_of(got, g.shape, i, "comp").astype(int) == label_components(g, conn)).all()
    rooted = components.rooted_cells(mask_df(spark, *GRIDS), conn, block=block)
    assert rooted.groupBy("tile_id").agg({"root": "approx_count_distinct"}).count() == len(GRIDS) - 1
    firsts = rooted.join(got, ["tile_id", "y", "x"]).groupBy("tile_id", "comp").agg({"root": "min"}).withColumnRenamed("min(root)", "root")
    assert rooted.select("tile_id", "root").distinct().exceptAll(firsts.select("tile_id", "root")).isEmpty()


@pytest.mark.parametrize(("finish", "hub"), [(10**6, 10**6), (0, 10**6), (0, 3)])
def test_contraction_with_and_without_hubs(spark, finish, hub, monkeypatch):
    monkeypatch.setattr(components, "_CHUNK", 5)
    rng = np.random.default_rng(finish + hub)
    edges = [(0, int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2)) if a != b] + [(1, 7, k) for k in range(8, 60)] + [(1, k, k + 1) for k in range(100, 180)] + [(2, 3, 4)] * 3
    want = {}
    for t in (0, 1, 2):
        own = [(a, b) for k, a, b in edges if k == t]
        nodes = sorted({x for e in own for x in e})
        place = {x: i for i, x in enumerate(nodes)}
        root = blocks.local_roots(len(nodes), np.array([place[a] for a, _ in own]), np.array([place[b] for _, b in own]))
        want |= {(t, x): nodes[root[i]] for i, x in enumerate(nodes)}
    out = components.contract(spark.createDataFrame(edges, "tile_id int, u bigint, v bigint").repartition(6), finish=finish, hub=hub).distinct().collect()
    assert {(r[0], r[1]): r[2] for r in out} == want and len(out) == len(want)


@pytest.mark.parametrize("seed", range(6))
def test_envelope_is_the_minimum(seed):
    rng = np.random.default_rng(seed)
    for _ in range(200):
        g = rng.integers(-1, 8, rng.integers(1, 30))
        left, right = rng.random(2) < 0.5
        at = [(q, int(v)) for q, v in enumerate(g) if v >= 0] + [(-1, 0)] * int(left) + [(len(g), 0)] * int(right)
        want = [min(((x - q) ** 2 + v * v for q, v in at), default=-1) for x in range(len(g))]
        assert blocks.envelope(g, bool(left), bool(right)).tolist() == want


def test_distance_of_thick_objects(spark):
    g = blobs(8, 40, 44, 0.62)
    g[5:30, 8:36] = True
    rooted = components.rooted_cells(mask_df(spark, g, np.ones((6, 9), bool)), 1, block=16).cache()
    for i, shape in enumerate((g.shape, (6, 9))):
        dist = grid_of(components.distance_to_background(rooted, None, ["tile_id", "root"]), shape, i, "dist")
        comp = label_components(g, 1) if i == 0 else np.ones(shape, int)
        for c in range(1, comp.max() + 1):
            for (y, x), d in box_distance(comp == c).items():
                assert dist[y, x] == pytest.approx(d)


@pytest.mark.parametrize(("block", "halo"), [(6, 2), (8, 4), (16, 6), (256, 32)])
def test_thinning_in_halos(spark, block, halo):
    g = blobs(11, 36, 41, 0.6)
    g[4:29, 10:34] = True  # many rounds, beside thin objects that leave early
    rooted = components.rooted_cells(mask_df(spark, g), 2)
    got = grid_of(components.skeleton(rooted, ["tile_id", "root"], block, halo), g.shape)
    comp, want = label_components(g, 2), np.zeros(g.shape, bool)
    for c in range(1, comp.max() + 1):
        want |= thin(comp == c)
    assert (got == want).all()

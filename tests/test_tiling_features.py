from __future__ import annotations

import numpy as np
import pytest
from helpers import dense_df, grid_of, mask_df, tiles
from pyspark.sql import functions as F

from gridloom.functions import color, extractors
from gridloom.operators import features, focal, tiling
from gridloom.plans import chain
from gridloom.sources import readers


@pytest.mark.parametrize("h,w,size,stride", [(10, 9, 4, 2), (9, 11, 3, 5), (7, 7, 16, 8)])
def test_windows_match_the_iterator(spark, h, w, size, stride):
    want = {(y, x, min(size, h - y), min(size, w - x)) for y in range(0, h, stride) for x in range(0, w, stride)}
    t = tiles(spark, (h, w))
    assert {tuple(r)[1:] for r in tiling.windows(t, size, stride).collect()} == want
    cells = tiling.assign_windows(dense_df(spark, {"v": np.zeros((h, w))}), size, stride)
    got = {(r["win_y"], r["win_x"], r["y"], r["x"]) for r in cells.collect()}
    assert got == {(a, b, y, x) for a, b, he, we in want for y in range(a, a + he) for x in range(b, b + we)}


def test_patch_labels_leave_a_gap(spark):
    m = np.zeros((4, 12), int)
    m[0, 0], m[:, 8:] = 1, 1
    df = tiling.patches(dense_df(spark, {"label": m}), tiles(spark, (4, 12)), 16, 16, 4)
    assert {r["px"]: r["kind"] for r in tiling.patch_labels(df, "label", .1).collect()} == {0: None, 1: "neg", 2: "pos"}


@pytest.mark.parametrize("mode,fn", [("flip_lr", np.fliplr), ("flip_ud", np.flipud), ("rot90", np.rot90), ("rot180", lambda a: np.rot90(a, 2)), ("rot270", lambda a: np.rot90(a, 3))])
def test_augmentation(spark, mode, fn):
    g = np.arange(12, dtype=float).reshape(3, 4)
    out = tiling.augment(dense_df(spark, {"v": g}), tiles(spark, (3, 4)), [mode, "rot45", mode]).drop("mode")
    want = fn(g)
    assert (grid_of(out, want.shape, value="v") == want).all() and out.count() == 12


def test_texture_matches_numpy(spark):
    rng = np.random.default_rng(2)
    rgb = rng.random((8, 12, 3)).round(3)
    ps, t = 4, tiles(spark, (8, 12))
    df = tiling.patches(dense_df(spark, {c: rgb[..., i] for i, c in enumerate("rgb")}), t, 16, 16, ps)
    gray = rgb @ [color.LUMA_R, color.LUMA_G, color.LUMA_B]
    gy, gx = np.gradient(gray)
    mag, ori = np.hypot(gx, gy), np.mod(np.arctan2(gy, gx), 2 * np.pi)
    blocks = {(r["py"], r["px"]): r for r in features.image_blocks(features.with_texture(df), 8, 16).collect()}
    assert len(blocks) == 6
    for (py, px), r in blocks.items():
        s = np.s_[py * ps:(py + 1) * ps, px * ps:(px + 1) * ps]
        assert r["grad_stats"] == pytest.approx([mag[s].mean(), mag[s].std()])
        assert r["rgb_stats"] == pytest.approx([*rgb[s].mean((0, 1)), *rgb[s].std((0, 1))])
        h = np.bincount(np.minimum((ori[s] / (2 * np.pi) * 8).astype(int), 7).ravel(), mag[s].ravel(), 8)
        assert r["grad_orient_hist"] == pytest.approx((h / (h.sum() + 1e-8)).tolist())
        codes = [sum(1 << k for k, (dy, dx) in enumerate(focal.RING8) if gray[y + dy, x + dx] >= gray[y, x])
                 for y in range(py * ps, (py + 1) * ps) for x in range(px * ps, (px + 1) * ps) if 0 < y < 7 and 0 < x < 11]
        h = np.bincount([c * 16 // 256 for c in codes], minlength=16)
        assert r["lbp_hist"] == pytest.approx((h / (h.sum() + 1e-8)).tolist())


def test_local_mean_identity_and_unit_length(spark):
    rows = [(0, 0, 0, y, x, [float(y), float(x), 1.0]) for y in range(2) for x in range(3)]
    df = spark.createDataFrame(rows, "tile_id int, win_y int, win_x int, py int, px int, vec array<double>")
    assert focal.local_mean(df, 0) is df
    v = np.array([r[5] for r in rows]).reshape(2, 3, 3)
    p = np.pad(v, ((1, 1), (1, 1), (0, 0)), mode="symmetric")
    mean = sum(p[a:a + 2, b:b + 3] for a in range(3) for b in range(3)) / 9
    mean /= np.linalg.norm(mean, axis=-1, keepdims=True) + 1e-8
    for r in focal.local_mean(df, 1).collect():
        assert r["vec"] == pytest.approx(mean[r["py"], r["px"]].tolist())


def test_scale_only_when_values_are_bytes(spark):
    for top, want in ((200.0, 200 / 255), (1.2, 1.2)):
        g = np.full((2, 2), top)
        df = tiling.assign_windows(dense_df(spark, {"r": g, "g": g, "b": g}), 4, 4)
        assert features.scale01(df).first()["r"] == pytest.approx(want)


def test_downsample_means_and_centres(spark):
    g = np.arange(35, dtype=float).reshape(5, 7)
    df = dense_df(spark, {"r": g, "g": g, "b": g})
    t = tiles(spark, (5, 7))
    mean = grid_of(readers.downsample(df, t, 2), (2, 3), value="r")
    rows, cols = [i * 2 // 5 for i in range(5)], [j * 3 // 7 for j in range(7)]
    want = np.array([[np.mean([g[i, j] for i in range(5) for j in range(7) if rows[i] == a and cols[j] == b]) for b in range(3)] for a in range(2)])
    assert np.allclose(mean, want)
    near = readers.downsample(df, t, 2, "nearest")
    assert near.count() == 6 and grid_of(near, (2, 3), value="r")[0, 0] == g[1, 1]
    out = readers.downsample_tiles(t, 2).first()
    assert (out["height"], out["width"], out["px"]) == (2, 3, 7 / 3)


def test_extractor_batches_equal_single_windows(spark):
    rng = np.random.default_rng(0)
    rgb = rng.random((9, 11, 3))
    placed = tiling.with_window_size(tiling.assign_windows(dense_df(spark, {c: rgb[..., i] for i, c in enumerate("rgb")}), 8, 4), tiles(spark, (9, 11)), 8)

    def fn(images, ps):
        n, h, w, c = images.shape
        return images.reshape(n, h // ps, ps, w // ps, ps, c).max(axis=(2, 4))

    out = extractors.with_extractor(extractors.window_images(placed), fn, 4).collect()
    assert len(out) == sum((min(8, 9 - y) // 4) * (min(8, 11 - x) // 4) for y in range(0, 9, 4) for x in range(0, 11, 4))
    for r in out:
        y, x = r["win_y"] + 4 * r["py"], r["win_x"] + 4 * r["px"]
        assert r["vec"] == pytest.approx(rgb[y:y + 4, x:x + 4].max((0, 1)).tolist(), rel=1e-6)


def test_chain_variants_nest(spark):
    rng = np.random.default_rng(5)
    h, w = 20, 18
    score = np.zeros((h, w))
    score[3:6, 1:16], score[12:15, 2:14] = .9, .8
    score += rng.random((h, w)) * .1
    byte = rng.integers(0, 255, (h, w))
    buf = np.zeros((h, w), bool)
    buf[:9] = True
    ctx = dense_df(spark, {"score": score, "r": byte, "g": byte, "b": byte, "label": np.zeros((h, w), bool), "buffer": buf, "road": np.zeros((h, w), bool)})
    from gridloom.operators.proposals import ProposalConfig

    cfg = chain.ChainConfig(threshold=.5, protect=None, proposal=ProposalConfig(min_area_px=20, min_length_m=5, max_width_m=6, min_skeleton_ratio=1, max_circularity=1))
    out = chain.infer_tiles(ctx, tiles(spark, (h, w)), cfg)
    m = {v: grid_of(out.filter(F.col("variant") == v), (h, w)) for v in ("raw", "crf", "shadow", "shadow_with_proposals")}
    assert m["raw"].any() and not m["raw"][9:].any() and (m["raw"] == m["crf"]).all()
    assert not (m["shadow"] & ~m["crf"]).any() and not (m["shadow"] & ~m["shadow_with_proposals"]).any()
    assert m["shadow_with_proposals"][12:15, 2:14].all()  # an accepted object outside the buffer


def test_context_clips_ground_truth(spark):
    from gridloom.operators.spatial import tile_context, workload

    t = tiles(spark, (2, 3))
    one = mask_df(spark, [[1, 1, 0], [0, 0, 0]])
    buf = mask_df(spark, [[1, 0, 0], [0, 0, 0]])
    img = spark.createDataFrame([(0, 0, 0, 9, 8, 7, .5)], "tile_id int, y int, x int, r int, g int, b int, score double")
    ctx = tile_context(img, one, one, buf, buf, t)
    assert ctx.count() == 6 and ctx.filter("gt").count() == 2 and ctx.filter("gt_eval").count() == 1
    row = workload(ctx, t, 2).first()
    assert (row["cells"], row["label_cells"], row["buffer_cells"], row["patch_rows"]) == (6, 2, 1, 1)


@pytest.mark.parametrize("size, stride, ps", [(8, 4, 4), (10, 4, 2), (6, 8, 2), (7, 3, 2)])
def test_summaries_of_blocks_repeated_equal_those_of_patches(spark, size, stride, ps):
    """Same patches and means as over repeated cells, for tiles that patches do not fill, and with cells missing; no row is repeated before a sum."""
    t = tiles(spark, (13, 10), (8, 8), (3, 1), (1, 9))
    some = tiling.dense_cells(t).filter("(y * 7 + x * 3) % 5 <> 0").withColumn("v", F.expr("(y * 31 + x * 17 + tile_id) % 23"))
    full = tiling.dense_cells(t).join(some, ["tile_id", "y", "x"], "left").fillna(0, ["v"])
    own = ["tile_id", *tiling.WINDOW, *tiling.PATCH, "h_eff", "w_eff"]
    want = sorted(map(tuple, tiling.patches(full, t, size, stride, ps).groupBy(*own).agg(F.avg("v")).collect()))
    assert sorted(map(tuple, tiling.patch_means(some, t, ["v"], size, stride, ps).select(*own, "v").collect())) == want and want
    if stride % ps:
        with pytest.raises(ValueError):
            tiling.repeat_blocks(full, t, size, stride, ps)
    else:
        summed = tiling.blocks(full, ps).groupBy("tile_id", *tiling.PATCH).agg(F.avg("v").alias("v"))
        assert sorted(map(tuple, tiling.repeat_blocks(summed, t, size, stride, ps).select(*own, "v").collect())) == want


def test_groups_within_a_large_cap_are_not_ordered(spark, monkeypatch):
    """Only groups above the cap are ranked; the others keep every row."""
    from gridloom.operators import banks

    df = spark.range(40).select("id", F.when(F.col("id") < 30, "a").when(F.col("id") < 38, "b").alias("g"))
    monkeypatch.setattr(banks, "RANK_LIMIT", 5)
    got = {r["g"]: r["count"] for r in banks.cap_sample(df, 9, 42, ["g"], ["id"]).groupBy("g").count().collect()}
    assert got == {"a": 9, "b": 8, None: 2}
    monkeypatch.setattr(banks, "group_ordinal", None)  # without a group above the cap nothing is ranked
    assert banks.cap_sample(df, 30, 42, ["g"], ["id"]).count() == 40

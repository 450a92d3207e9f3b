"""Steps that must not shuffle cells once for each window, neighbour or summary."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import extractors
from gridloom.operators import focal, metrics, tiling
from gridloom.streaming import live
from helpers import blobs, dense_df, grid_of, mask_df, tiles


@pytest.mark.parametrize(("stride", "ps"), [(4, 4), (4, 2), (3, 2)])
def test_patch_sums_and_labels_of_sparse_cells(spark, stride, ps):
    g = blobs(3, 9, 11)
    t, mask = tiles(spark, (9, 11), (4, 3)), mask_df(spark, g)
    full = np.zeros((9, 11), int)
    full[g] = 1 + np.arange(g.sum())
    cells = dense_df(spark, {"v": full}).filter("v > 0")
    got = {tuple(r[c] for c in ("tile_id", "win_y", "win_x", "py", "px")): r["v"] for r in tiling.patch_sums(cells, t, ["v"], 8, stride, ps).collect()}
    want = {}
    for tile, a in enumerate((full, np.zeros((4, 3), int))):
        h, w = a.shape
        for y in range(0, h, stride):
            for x in range(0, w, stride):
                for py in range(min(8, h - y) // ps):
                    for px in range(min(8, w - x) // ps):
                        want[tile, y, x, py, px] = int(a[y + py * ps:y + (py + 1) * ps, x + px * ps:x + (px + 1) * ps].sum())
    assert got == want
    if stride % ps == 0:
        dense = dense_df(spark, {"label": g.astype(int)})
        one = {tuple(r) for r in tiling.patch_labels(tiling.patches(dense, t, 8, stride, ps), thr=0.3).collect()}
        assert {tuple(r) for r in tiling.mask_patch_labels(mask, t.filter("tile_id = 0"), 8, stride, ps, 0.3).collect()} == one


def test_median_counts_rows_of_several_tiles(spark):
    grids = [blobs(1, 9, 7), blobs(2, 1, 5), np.ones((2, 1), bool), blobs(4, 30, 40)]
    out = focal.median3(mask_df(spark, *grids), tiles(spark, *[g.shape for g in grids])).cache()
    for k, g in enumerate(grids):
        pad = np.pad(g.astype(int), 1, mode="edge")
        near = sum(pad[a:a + g.shape[0], b:b + g.shape[1]] for a in range(3) for b in range(3))
        assert (grid_of(out, g.shape, k) == (near >= 5)).all()
    assert out.groupBy("tile_id", "y", "x").count().filter("count > 1").isEmpty()


def test_median_sends_rows_of_columns(spark):
    """Before, each cell was repeated nine times and counted by cell."""
    plan = focal.median3(mask_df(spark, blobs(1, 9, 7)), tiles(spark, (9, 7)))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(x" in plan


def test_tile_images_equal_window_images(spark):
    rng = np.random.default_rng(0)
    rgb = rng.integers(0, 250, (9, 11, 3))
    rgb[rng.random((9, 11)) < 0.6] = 0
    rgb[4] = 0
    t = tiles(spark, (9, 11), (3, 2))
    dense = dense_df(spark, {c: rgb[..., i] for i, c in enumerate("rgb")})
    black = tiling.dense_cells(t.filter("tile_id = 1")).select("*", *[F.lit(0).alias(c) for c in "rgb"])
    placed = tiling.with_window_size(tiling.assign_windows(dense.unionByName(black), 8, 4), t, 8)
    cols = ["tile_id", "win_y", "win_x", "h_eff", "w_eff", "pixels"]
    want = sorted(map(tuple, extractors.window_images(placed).select(cols).collect()))
    assert sorted(map(tuple, extractors.tile_images(dense.filter("r + g + b > 0"), t, 8, 4).select(cols).collect())) == want
    assert len(want) == 10


def test_summaries_of_spans_that_pause_and_runs_that_go_on(spark, tmp_path, monkeypatch):
    """Before, the query dealt each batch through one task, and each sum was repeated for every later summary before it was added up."""
    rows = [(i, "a", "s" if i % 5 == 0 and i < 40 else "t", None, float(i), i % 3 == 2) for i in range(90)]
    schema = "position bigint, phase string, stage string, substage string, duration_s double, final boolean"
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for low, high in ((0, 31), (31, 32), (32, 90)):
        spark.createDataFrame(rows[low:high], schema).repartition(3).write.mode("append").parquet(src)
        live.stream_tile_summaries(spark.readStream.schema(schema).parquet(src), 4, out, ck).awaitTermination()
    got = sorted((r["tiles"], r["stage"], r["count"], r["total_s"], r["min_s"], r["max_s"]) for r in live.tile_summaries(spark, out).collect())
    want = []
    for tiles_ in range(4, 31, 4):
        for stage in "st":
            d = [r[4] for r in rows[:3 * tiles_] if r[2] == stage]
            want.append((tiles_, stage, len(d), sum(d), min(d), max(d)))
    assert got == want
    from gridloom.queries import QUERIES

    monkeypatch.setattr(type(spark.range(1)), "coalesce", None)
    assert QUERIES["STR-03"](spark, "/root/testdata/sf0.001").count() > 0


def test_stage_summary_reads_its_source_once(spark, tmp_path):
    """Before, the means and each of both medians counted all cells anew."""
    path = str(tmp_path / "rows")
    spark.createDataFrame([("knn_raw", 1.0, *[i / 4] * 4) for i in range(5)], "stage string, weight double, precision double, recall double, iou double, f1 double").write.parquet(path)
    out = metrics.stage_summary(spark.read.parquet(path))
    assert not any(path in f for f in out.inputFiles())
    assert (out.first()["iou_wmean"], out.first()["f1_median"]) == (0.5, 0.5)

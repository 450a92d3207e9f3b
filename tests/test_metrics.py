from __future__ import annotations

import numpy as np
import pytest
from helpers import dense_df, mask_df, tiles
from pyspark.sql import functions as F

from gridloom.operators import metrics, tuning


def test_confusion_literal(spark):
    pred, gt = np.array([[1, 0], [1, 0]], bool), np.array([[1, 0], [0, 0]], bool)
    row = metrics.mask_confusion(mask_df(spark, pred), mask_df(spark, gt), tiles(spark, (2, 2))).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (1, 1, 0, 2)
    assert row["iou"] == pytest.approx(0.5) and row["recall"] == pytest.approx(1.0)


def test_fine_tune_literal(spark):
    df = dense_df(spark, {"score": np.array([[.2, .8], [.6, .1]]), "gt": np.array([[0, 1], [1, 0]], bool)})
    row = metrics.fine_tune(df, F.col("score"), 0.5, 0.1, 0.0).first()
    assert row["threshold"] == 0.5 and row["iou"] == pytest.approx(1.0)


@pytest.mark.parametrize("n", [3, 25])
def test_sweep_equals_direct_counts(spark, n):
    rng = np.random.default_rng(n)
    score, gt, keep = rng.random((12, 9)).round(2), rng.random((12, 9)) < .3, rng.random((12, 9)) < .7
    thresholds = [i / n for i in range(n + 1)][::-1] + [0.5]  # unsorted and repeated
    df = dense_df(spark, {"score": score, "gt": gt, "buffer": keep})
    rows = {r["thr_idx"]: r for r in metrics.sweep(df, F.col("score"), thresholds, keep=F.col("buffer")).collect()}
    assert len(rows) == len(thresholds)
    for i, t in enumerate(thresholds):
        p = (score >= t) & keep
        assert (rows[i]["tp"], rows[i]["fp"], rows[i]["fn"], rows[i]["tn"]) == ((p & gt).sum(), (p & ~gt).sum(), (~p & gt).sum(), (~p & ~gt).sum())


def test_sweep_with_nothing_kept(spark):
    df = dense_df(spark, {"score": np.ones((2, 2)), "gt": np.ones((2, 2), bool), "buffer": np.zeros((2, 2), bool)})
    rows = metrics.sweep(df, F.col("score"), [0.2, 0.6], keep=F.col("buffer")).collect()
    assert [(r["tp"], r["fn"]) for r in rows] == [(0, 4), (0, 4)]


def test_first_best_keeps_the_first(spark):
    df = spark.createDataFrame([(0, .4), (1, .7), (2, .7)], "o int, iou double")
    assert metrics.first_best(df, "iou", ["o"]).first()["o"] == 1
    assert metrics.first_best(df.filter("o > 5"), "iou", ["o"]).count() == 0


def test_weighted_mean_falls_back(spark):
    df = spark.createDataFrame([(1.0, 0.0), (3.0, 0.0)], "x double, w double")
    w = metrics.weighted_mean(F.col("x"), F.col("w"))
    assert df.agg(w.alias("m")).first()[0] == 2.0
    assert df.filter("x > 9").agg(w.alias("m")).first()[0] == 0.0
    assert df.agg(metrics.weighted_or_zero(F.col("x"), F.col("w")).alias("m")).first()[0] == 0.0


def test_raw_stream_wins_a_tie(spark):
    base = dense_df(spark, {"score": np.array([[.9, .1]]), "gt": np.array([[1, 0]], bool), "buffer": np.ones((1, 2), bool), "road": np.zeros((1, 2), bool)})
    cells = base.withColumn("cand_ord", F.lit(0)).withColumn("stream", F.explode(F.array(F.lit("xgb"), F.lit("raw"))))
    w = spark.createDataFrame([(0, 1.0)], "tile_id int, weight double")
    row = tuning.select_penalty(cells, [0.8, 0.9], [0.5], w).first()
    assert row["stream"] == "raw" and row["penalty"] == 0.8


def test_best_fold_without_rows_is_an_error(spark):
    empty = spark.createDataFrame([], "fold bigint, stage string, iou double, weight double")
    with pytest.raises(Exception, match="no fold"):
        metrics.best_fold(empty).collect()


def test_score_hist_flat_scores(spark):
    df = spark.createDataFrame([(0.5, True)] * 3, "score double, buffer boolean")
    assert metrics.score_hist(df, "score", "buffer", 4).filter("n > 0").collect()[0]["n"] == 3


def test_joint_sweep_equals_a_sweep_for_each_setting(spark):
    rng = np.random.default_rng(6)
    rows = [(int(t), float(a), float(b), bool(g), bool(k)) for t, a, b, g, k in zip(rng.integers(0, 3, 300), rng.random(300).round(2), rng.random(300).round(2), rng.random(300) < .4, rng.random(300) < .7, strict=True)]
    df = spark.createDataFrame(rows, "tile_id int, a double, b double, gt boolean, keep boolean")
    thr, guards = [0.5, 0.2, 0.5, 0.9], [0.8, 0.3]
    ordered = sorted(set(thr))
    ranks = {f"_r{i}": F.when(F.col("keep"), metrics.threshold_rank(F.col("a") * w, ordered)).otherwise(F.lit(0)) for i, w in enumerate((1.0, 0.7))} | {"_g": metrics.threshold_rank(F.col("b"), sorted(guards))}
    settings = [({"w": i, "g": g}, F.when(F.col("_g") > sorted(guards).index(g), len(ordered)).otherwise(F.col(f"_r{i}"))) for i in (0, 1) for g in guards]
    got = {tuple(r) for r in metrics.joint_sweep(df, ranks, settings, thr).select("w", "g", "tile_id", "thr_idx", "tp", "fp", "fn", "tn").collect()}
    want = set()
    for i, w in enumerate((1.0, 0.7)):
        for g in guards:
            rank = F.when(F.col("keep"), F.col("a") * w).otherwise(-1.0)
            want |= {(i, g, *r) for r in metrics.sweep(df, rank, thr, always=F.col("b") >= g).select("tile_id", "thr_idx", "tp", "fp", "fn", "tn").collect()}
    assert got == want and len(got) == 4 * 3 * 4

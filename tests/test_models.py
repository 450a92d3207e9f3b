from __future__ import annotations

import numpy as np
import pytest
from helpers import dense_df, tiles
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from gridloom.operators import banks, boosting, features, knn
from gridloom.plans.scratch import new_path
from gridloom.sources import stores


def vec_df(spark, m, start=0):
    return spark.createDataFrame([(start + i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id bigint, vec array<double>")


def test_topk_literal(spark):
    q, b = vec_df(spark, [(1, 0), (0, 1)]), vec_df(spark, [(1, 0), (.9, .1), (0, 1)])
    assert [r["sim"] for r in knn.topk(q, b, 1).orderBy("query_id").collect()] == [1.0, 1.0]


@pytest.mark.parametrize("k", [1, 7, 50])
def test_blocks_equal_broadcast_and_brute_force(spark, k):
    rng = np.random.default_rng(k)
    q, b = rng.integers(-3, 4, (30, 5)), rng.integers(-3, 4, (40, 5))  # integers give many equal similarities
    whole = knn.topk(vec_df(spark, q), vec_df(spark, b, 100), k).collect()
    parts = knn.topk(vec_df(spark, q), vec_df(spark, b, 100), k, block_bytes=7 * 56).collect()
    sims = q @ b.T
    want = {(i, r + 1, 100 + j, float(sims[i, j])) for i in range(30) for r, j in enumerate(sorted(range(40), key=lambda j: (-sims[i, j], j))[:k])}
    assert {tuple(r) for r in whole} == want == {tuple(r) for r in parts}


def test_near_ties_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 33))
    b = np.concatenate([base * (1 + i * 1e-16) for i in range(12)] + [rng.normal(size=(200, 33))])
    q = np.concatenate([base, base[:, ::-1], rng.normal(size=(20, 33))])
    want = None
    for size in (1, 5 * 33 * 8, 50 * 33 * 8, 1 << 22):
        got = sorted(tuple(r) for r in knn.topk(vec_df(spark, q), vec_df(spark, b).repartition(3), 5, block_bytes=size).collect())
        assert len(got) == 5 * len(q) and (want is None or got == want)
        want = got


def test_bank_and_queries_are_not_shuffled(spark):
    q = vec_df(spark, np.eye(4))
    plan = knn.topk(q, q, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "query_id" in plan[plan.index("Exchange hashpartitioning"):][:60]


def test_empty_sides(spark):
    q, none = vec_df(spark, np.eye(3)), spark.createDataFrame([], "vec_id bigint, vec array<double>")
    assert knn.topk(q, none, 2).collect() == [] and knn.topk(none, q, 2).collect() == []


def test_score_without_negative_bank(spark):
    q, b = vec_df(spark, [(1, 0)]), vec_df(spark, [(1, 0), (0, 1)])
    assert knn.knn_score(q, b, None, 2, 1.0).first()["score"] == pytest.approx(.5)
    assert knn.knn_score(q, b, b.filter("vec_id = 1"), 1, .5).first()["score"] == pytest.approx(1.0)


def bank_rows(spark):
    return spark.createDataFrame([(t, i, "pos" if i % 3 == 0 else "neg") for t in range(3) for i in range(40)], "tile_id int, vec_id int, polarity string")


def test_caps_are_exact_and_seeded(spark):
    df = bank_rows(spark)
    a = banks.cap_sample(df, 9, 42, ["tile_id"], ["tile_id", "vec_id"]).collect()
    assert sorted(a) == sorted(banks.cap_sample(df.repartition(7), 9, 42, ["tile_id"], ["tile_id", "vec_id"]).collect())
    assert sorted(a) != sorted(banks.cap_sample(df, 9, 43, ["tile_id"], ["tile_id", "vec_id"]).collect())
    assert len(a) == 27 and banks.cap_sample(df, 99, 1, ["tile_id"], ["vec_id"]).count() == 120


def test_large_caps_take_the_same_rows(spark, monkeypatch):
    df = bank_rows(spark)
    a = sorted(banks.cap_sample(df, 9, 42, ["tile_id"], ["tile_id", "vec_id"]).collect())
    monkeypatch.setattr(banks, "RANK_LIMIT", 5)
    assert a == sorted(banks.cap_sample(df, 9, 42, ["tile_id"], ["tile_id", "vec_id"]).select(df.columns).collect())


def test_combined_bank_may_exceed_a_cap(spark):
    out = banks.combine_sources([bank_rows(spark), bank_rows(spark)], {"pos": 2, "neg": 4}, 1, ["tile_id"], ["tile_id", "vec_id"])
    assert {r["polarity"]: r["count"] for r in out.groupBy("polarity").count().collect()} == {"pos": 12, "neg": 24}
    with pytest.raises(ValueError):
        banks.combine_sources([], {"pos": 1}, 1, ["tile_id"], ["vec_id"])


@pytest.mark.parametrize("h,w", [(16, 12), (11, 7), (4, 4), (5, 9)])
def test_upsample_matches_the_formula(spark, h, w):
    ps = 4
    hp, wp = h // ps, w // ps
    g = np.random.default_rng(h).random((hp, wp))

    def axis(n, p):
        u = (np.arange(n) + .5) * p / n - .5
        lo = np.floor(u).astype(int)

        def mirror(i):
            m = i % max(2 * p - 2, 1)
            return np.where(m >= p, 2 * p - 2 - m, m)
        return mirror(lo), mirror(lo + 1), u - lo

    a0, a1, ty = axis(h, hp)
    b0, b1, tx = axis(w, wp)
    ty = ty[:, None]
    want = (g[np.ix_(a0, b0)] * (1 - tx) + g[np.ix_(a0, b1)] * tx) * (1 - ty) + (g[np.ix_(a1, b0)] * (1 - tx) + g[np.ix_(a1, b1)] * tx) * ty
    patches = spark.createDataFrame([(0, 8, 16, i, j, float(g[i, j])) for i in range(hp) for j in range(wp)], "tile_id int, win_y int, win_x int, py int, px int, score double")
    wins = spark.createDataFrame([(0, 8, 16, h, w)], "tile_id int, win_y int, win_x int, h_eff int, w_eff int")
    got = np.zeros((h, w))
    rows = boosting.upsample_bilinear(patches, wins, ps).collect()
    for r in rows:
        got[r["y"] - 8, r["x"] - 16] = r["score"]
    assert len(rows) == h * w and np.allclose(got, want)


def test_blend_counts_only_scoring_windows(spark):
    dense = dense_df(spark, {"v": np.zeros((1, 3))})
    df = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 0, 3.0), (0, 0, 1, 5.0)], "tile_id int, y int, x int, score double")
    assert [r["score"] for r in boosting.blend_windows(df, dense).orderBy("x").collect()] == [2.0, 5.0, 0.0]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 4))
    y = (x[:, 0] + .5 * x[:, 1] > 0).astype(float)
    return spark.createDataFrame([(i, [float(a) for a in v], float(t)) for i, (v, t) in enumerate(zip(x, y))], "id int, vec array<double>, y double").cache()


def test_trees_learn_and_searches_pick_the_best(spark, rows):
    scored = boosting.score_patches(boosting.train(rows, {"max_depth": 3, "eta": .3}, 8), rows)
    assert scored.agg(boosting.log_loss(F.col("y"), F.col("score"))).first()[0] < boosting.prior_loss(.5) * .6
    grid = boosting.grid({"max_depth": [1, 3], "eta": [.3], "reg_alpha": [.1]})
    assert [g["max_depth"] for g in grid] == [1, 3]
    _, best, losses = boosting.search_logloss(rows, grid, 5, .3, 42, ["id"])
    assert best == grid[int(np.argmin(losses))]
    image = rows.select("vec", (F.col("y") > 0).alias("gt"))
    _, _, row = boosting.search_iou(rows, image, grid, [.3, .5, .7], 5, .3, 42, ["id"])
    assert row["iou"] > .7


def test_split_sizes(spark, rows):
    out = boosting.split_rows(rows, .3, 42, ["id"])
    assert out.filter("not is_val").count() == int(240 * .7) and out.count() == 240


def test_bundle_round_trip(spark, rows):
    path = new_path(spark, "bundle")
    model = boosting.train(rows, {"max_depth": 2}, 3)
    stores.save_bundle(PipelineModel([model]), {"threshold": .4}, path, spark)
    loaded, settings = stores.load_bundle(path, spark)
    a, b = (sorted(r["score"] for r in boosting.score_patches(m, rows).collect()) for m in (model, loaded.stages[0]))
    assert a == b and settings == {"threshold": .4}
    with pytest.raises(FileNotFoundError):
        stores.load_bundle(path + "-none", spark)


def test_guard_flags(spark):
    a = dense_df(spark, {"score": np.array([[.2, .8]])})
    near, far = a.withColumn("score", F.col("score") + 1e-7), a.withColumn("score", F.col("score") + .01)
    assert not boosting.score_guard(a, near, .5).first()["mismatch"]
    row = boosting.score_guard(a, far, .5).first()
    assert row["mismatch"] and row["same_mask"] and not row["all_close"]


def test_importance_accumulates_upwards(spark):
    g = spark.createDataFrame([("e_1", 5.0), ("e_2", 3.0), ("e_3", 2.0), ("z", 9.0)], "feature string, gain double")
    out = {r["feature"]: r["cum_share"] for r in boosting.importance_topk(g, "e_", 2).collect()}
    assert out == {"e_2": pytest.approx(3 / 8), "e_1": pytest.approx(1.0)}


def test_zscore_errors(spark):
    with pytest.raises(Exception, match="no rows"):
        features.zscore_fit(vec_df(spark, [(1, 2)]).filter("vec_id < 0")).collect()
    stats = features.zscore_fit(vec_df(spark, [(1, 2), (3, 2)]))
    assert [round(x, 6) for x in features.zscore_apply(vec_df(spark, [(1, 2)]), stats).first()["vec"]] == [-1.0, 0.0]
    with pytest.raises(Exception, match="dimension"):
        features.zscore_apply(vec_df(spark, [(1, 2, 3)]), stats).collect()


def test_fuse_falls_back_to_the_base(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0])], "embedding array<double>, rgb_stats array<double>")
    assert features.fuse_blocks(df, {"embedding": 0, "rgb_stats": 0}, True).first()["vec"] == [3.0, 4.0]
    assert features.fuse_blocks(df, {"embedding": 1, "rgb_stats": .5}, False).first()["vec"] == [3.0, 4.0, .5]
    assert sum(x * x for x in features.fuse_blocks(df, features.KNN_WEIGHTS, True).first()["vec"]) == pytest.approx(1, abs=1e-6)


def test_bank_skips_tiles_without_positives(spark):
    key = "tile_id int, win_y int, win_x int, py int, px int"
    f = spark.createDataFrame([(t, 0, 0, 0, p, [1.0]) for t in (0, 1) for p in range(3)], key + ", vec array<double>")
    labels = spark.createDataFrame([(0, 0, 0, 0, 0, "pos"), (0, 0, 0, 0, 1, "neg"), (0, 0, 0, 0, 2, None), (1, 0, 0, 0, 0, "neg")], key + ", kind string")
    assert {(r["tile_id"], r["polarity"]) for r in banks.build_bank(f, labels).collect()} == {(0, "pos"), (0, "neg")}
    assert banks.training_rows(f, labels).count() == 3
    assert tiles(spark, (1, 1)).count() == 1


def test_unknown_tree_parameters_are_errors(spark):
    from gridloom.operators import boosting

    with pytest.raises(ValueError, match="max_dept"):
        boosting.classifier({"max_dept": 3}, 1)
    boosting.classifier({"max_depth": 3, "reg_alpha": 1.0}, 1)

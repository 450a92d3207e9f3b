from __future__ import annotations

import math
import os
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import catalog, spanlog
from gridloom.plans import ordering, scratch
from gridloom.sources import readers, stores
from gridloom.streaming import live


def paths(spark, n):
    return spark.createDataFrame([(f"tile_{i:02d}",) for i in range(n)], "path string").repartition(3)


def test_round_robin_and_manifest(spark):
    out = catalog.round_robin(paths(spark, 4), 2)
    assert {(r["path"], r["shard"]) for r in out.collect()} == {("tile_00", 0), ("tile_02", 0), ("tile_01", 1), ("tile_03", 1)}
    assert {r["shard"]: r["n_tiles"] for r in catalog.shard_manifest(catalog.round_robin(paths(spark, 2), 2), 3).collect()} == {0: 1, 1: 1, 2: 0}


def test_batch_controller(spark):
    b = catalog.contiguous_batches(paths(spark, 4), 2).select("path", "batch")
    log = spark.createDataFrame([(0, "tile_00", "done"), (0, "tile_00", "done"), (0, "tile_01", "done"), (1, "tile_02", "done"), (1, "tile_03", "failed")], "batch bigint, tile_path string, status string")
    retries = spark.createDataFrame([(1, 2)], "batch bigint, retry_count int")
    rows = {r["batch"]: r for r in catalog.batch_progress(b, log, retries, 3).collect()}
    assert rows[0]["complete"] and not rows[1]["complete"] and rows[1]["done_tiles"] == 1 and rows[1]["retryable"]
    assert not catalog.batch_progress(b, log, retries, 2).filter("retryable").count()
    assert not catalog.ready_to_merge(catalog.batch_progress(b, log, retries, 2)).first()["ready"]


@pytest.mark.parametrize("n,v", [(5, 2), (4, 1), (7, 3)])
def test_cyclic_folds(spark, n, v):
    folds = {}
    for r in catalog.loo_folds(paths(spark, n), v).collect():
        folds.setdefault((r["fold"], r["role"]), set()).update(range(r["from_idx"], r["to_idx"] + 1))
    for i in range(n):
        val = {(i + j) % n for j in range(v)}
        assert folds[i, "val"] == val and folds[i, "train"] == set(range(n)) - val
    tiles = catalog.fold_tiles(paths(spark, n), v).collect()
    assert {(r["fold"], r["idx"]) for r in tiles} == {(i, (i + j) % n) for i in range(n) for j in range(v)}
    with pytest.raises(ValueError):
        catalog.loo_folds(paths(spark, 2), 2)


@pytest.mark.parametrize("n,f,want", [(10, .25, 2), (10, .35, 4), (2, .9, 1), (3, .01, 1)])
def test_split_sizes_round_half_even(spark, n, f, want):
    out = catalog.train_val_split(paths(spark, n), f, 42)
    assert out.filter("role = 'val'").count() == want and out.count() == n
    assert sorted(out.collect()) == sorted(catalog.train_val_split(paths(spark, n).repartition(2), f, 42).collect())


def test_single_tile_serves_both(spark):
    assert {r["role"] for r in catalog.train_val_split(paths(spark, 1), .3, 1).collect()} == {"train", "val"}


def test_pending_index(spark):
    done = spark.createDataFrame([("tile_01",), ("tile_01",)], "tile_path string")
    rows = sorted(catalog.pending_tiles(paths(spark, 4), done).collect())
    assert [(r["path"], r["idx"], r["total"]) for r in rows] == [("tile_00", 1, 3), ("tile_02", 2, 3), ("tile_03", 3, 3)]


def test_group_order_on_a_hot_group(spark):
    """Most rows in one group: numbers stay consecutive and exact."""
    df = spark.range(3000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"), F.col("id").alias("v"))
    out = ordering.group_ordinal(df, ["g"], [F.desc("v")], "n").toPandas()
    for _, part in out.groupby("g"):
        assert part.sort_values("v", ascending=False)["n"].tolist() == list(range(1, len(part) + 1))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(0)
    rows = [("a", float(x)) for x in rng.integers(0, 30, 401)] + [("b", float(x)) for x in rng.random(10)] + [("c", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = {r["g"]: r for r in ordering.exact_quantiles(df, ["g"], "v", {"m": ordering.MEDIAN, "p": ordering.nearest_rank(.9)}).collect()}
    for g in "abc":
        vals = sorted(v for k, v in rows if k == g)
        assert out[g]["m"] == pytest.approx(statistics.median(vals)) and out[g]["p"] == vals[max(1, math.ceil(.9 * len(vals))) - 1]


def test_scratch_folder_comes_from_the_session(spark):
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, name, default):
            assert name == "spark.checkpoint.dir"
            return self.value

    class Session:
        sparkContext = spark.sparkContext
        conf = Conf("/shared/scratch/")

    assert scratch.new_path(Session(), "x").startswith("/shared/scratch/gridloom/x-")
    assert scratch.cut(spark.range(3)).count() == 3


SPAN = "duration_s double, kind string, phase string, stage string, substage string, tile string, run_id string"


def test_span_rows_literal(spark):
    df = spark.createDataFrame([(10.0, "span", "holdout_inference", "score", "a", "t", "r"), (20.0, "span", "holdout_inference", "score", "b", "t", "r"),
                                (3.0, "span", "holdout_inference", "score", "", "t", "r"), (9.0, "summary", None, "score", "a", None, None)], SPAN)
    sel = spanlog.filter_spans(df, ["span", "timer"], "holdout_inference")
    row = spanlog.by_stage(sel).first()
    assert row["total_s"] == 33 and row["mean_s"] == 11 and row["median_s"] == 10 and row["p90_s"] == 20
    assert {r["substage"]: r["total_s"] for r in spanlog.by_substage(sel).collect()} == {"a": 10, "b": 20, "<none>": 3}
    assert spanlog.filter_spans(df, ["span"], focus="SCORE::B").count() == 1


def test_span_tiles_literal(spark):
    df = spark.createDataFrame([(8.0, "span", "p", "xgb", "fit", "tile_a", "r"), (5.0, "span", "p", "xgb", "score", "tile_a", "r"), (6.0, "span", "p", "xgb", "fit", "tile_b", "r")], SPAN)
    assert {r["tile"]: r["total_s"] for r in spanlog.by_tile(df).collect()} == {"tile_a": 13, "tile_b": 6}
    top = spanlog.hottest(df, 1, 1).first()
    assert (top["tile"], top["contributor"], top["duration_s"]) == ("tile_a", "xgb::fit", 8)
    assert spanlog.by_stage(df).first()["total_s"] == 19


def test_empty_log_gives_zeros(spark):
    row = spanlog.duration_stats(spark.createDataFrame([], SPAN), []).first()
    assert row["count"] == 0 and row["max_s"] == 0 and row["median_s"] == 0


def test_outlier_warning(spark):
    rows = [(1.0, "span", "p", "a", "x", "t", "r")] * 5 + [(70.0, "span", "p", "a", "x", "t", "r"), (100.0, "span", "p", "b", "y", "t", "r")]
    out = spanlog.outlier_warning(spanlog.by_substage(spark.createDataFrame(rows, SPAN))).collect()
    assert [(r["stage"], r["max_s"]) for r in out] == [("a", 70.0)]


def test_malformed_lines_are_dropped(spark):
    lines = ['{"kind": "span", "stage": "a", "duration_s": 2, "extra": {"k": "1"}}', "", "nope", "[1, 2]", '"text"', '{"kind": "timer"', '{"stage": "b"}', "{}"]
    rows = readers.parse_spans(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["kind"], r["stage"], r["duration_s"], r["extra"]) for r in rows] == [("span", "a", 2.0, {"k": "1"}), ("", "b", 0.0, {}), ("", None, 0.0, {})]


def test_done_log_and_stream_agree(spark, tmp_path):
    lines = ['{"tile_path": "a", "status": "done"}', '{"tile_path": "b", "status": "failed"}', '{"tile_path": "a", "status": "done"}', "broken", '{"status": "done"}']
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "x.jsonl").write_text("\n".join(lines))
    assert [r[0] for r in readers.read_done(spark, str(tmp_path / "log")).collect()] == ["a"]
    src = spark.readStream.schema(readers.DONE_SCHEMA).json(str(tmp_path / "log"))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    live.stream_done(src, out, ck).awaitTermination()
    (tmp_path / "log" / "y.jsonl").write_text('{"tile_path": "c", "status": "done"}\n{"tile_path": "a", "status": "done"}')
    live.stream_done(src, out, ck).awaitTermination()  # restart continues from the checkpoint
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == ["a", "c"]


def test_tile_sources(spark, tmp_path):
    for n in ("b.tif", "a.tif", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [r["path"].rsplit("/", 1)[1] for r in readers.list_tiles(spark, str(tmp_path)).collect()] == ["a.tif", "b.tif"]
    with pytest.raises(Exception):
        readers.list_tiles(spark, str(tmp_path / "missing")).collect()
    (tmp_path / "list.lst").write_text(" x \n\n y\n")
    file = str(tmp_path / "list.lst")
    assert [r[0] for r in readers.resolve_tiles(spark, file, str(tmp_path)).collect()] == ["x", " y".strip()]
    kept = readers.resolve_tiles(spark, None, str(tmp_path), label_filter=lambda d: d.filter(F.col("path").endswith("a.tif")))
    assert [(r["origin"]) for r in kept.collect()] == ["folder"]
    with pytest.raises(ValueError):
        readers.resolve_tiles(spark)


def test_feature_count_of_a_missing_table(spark):
    assert stores.count_features(spark, scratch.new_path(spark, "none")) == 0


def test_listing_stays_in_its_folder_and_resumes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.tif", "b.tif", "sub/c.tif"):
        (tmp_path / name).write_bytes(b"x")
    listed = readers.list_tiles(spark, str(tmp_path)).select(F.col("path").alias("tile_path"))
    assert [r[0] for r in listed.collect()] == [f"{tmp_path}/a.tif", f"{tmp_path}/b.tif"]
    done = spark.createDataFrame([(f"{tmp_path}/a.tif", "done")], "tile_path string, status string")
    assert [r[0] for r in listed.join(readers.finished(done), "tile_path", "left_anti").collect()] == [f"{tmp_path}/b.tif"]


def test_lists_are_label_filtered_but_not_list_files(spark, tmp_path):
    rows = spark.createDataFrame([("x",), ("y",)], "path string")
    keep = lambda d: d.filter("path = 'x'")
    for given in ({"explicit": rows}, {"legacy": rows}):
        assert [r["path"] for r in readers.resolve_tiles(spark, label_filter=keep, **given).collect()] == ["x"]


def test_quoted_duration_is_a_number(spark):
    rows = readers.parse_spans(spark.createDataFrame([('{"stage": "s", "duration_s": "1.5"}',), ('{"stage": "t", "duration_s": 2}',)], "value string")).collect()
    assert [r["duration_s"] for r in rows] == [1.5, 2.0]


def test_stores_keep_other_images(spark, tmp_path):
    from gridloom.sources import stores

    def rows(*ids, v=0.0):
        return spark.createDataFrame([(i, w, 0, 0, 0, v) for i in ids for w in (0, 16)], "image_id long, win_y int, win_x int, py int, px int, v double")

    path = str(tmp_path / "features")
    stores.write_features(rows(1), path, "s", 4, 1)
    stores.write_features(rows(2), path, "s", 4, 1)
    stores.write_features(rows(1, v=9.0).filter("win_y = 16"), path, "s", 4, 1)
    got = sorted((r["image_id"], r["win_y"], r["v"]) for r in stores.read_features(spark, path).collect())
    assert got == [(1, 0, 0.0), (1, 16, 9.0), (2, 0, 0.0), (2, 16, 0.0)]
    bank = str(tmp_path / "bank")
    for i, spec in ((1, "a"), (2, "a"), (1, "b")):
        key = spark.createDataFrame([(i, spec, 4, 0, 1, [1.0])], "image_id long, spec_hash string, ps int, context int, resample int, vec array<double>")
        stores.write_bank(key, bank)
    assert sorted((r["image_id"], r["spec_hash"]) for r in stores.read_bank(spark, bank).collect()) == [(1, "b"), (2, "a")]


def test_appending_polygons_again_changes_nothing(spark, tmp_path):
    from gridloom.sources import stores

    path = str(tmp_path / "polygons")
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    for start in (10, 12, 12):
        stores.append_polygons(rows, path, start, [F.col("k")])
    assert sorted(r["geom_id"] for r in spark.read.parquet(path).collect()) == [10, 11, 12, 13] and stores.count_features(spark, path + "-none") == 0


def test_owned_scratch_tables_go(spark):
    import os

    from gridloom.plans.scratch import cut, owned

    with owned(spark):
        df = cut(spark.range(3), "mine")
        path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert df.count() == 3 and os.path.isdir(path)
    assert not os.path.exists(path)


def test_tile_folder_in_other_spellings(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for n in ("in/b.tif", "in/a.tif", "in/sub/c.tif"):
        (tmp_path / n).write_bytes(b"x")
    d = f"{tmp_path}/in"
    spellings = [d, f"{d}/", f"file:{d}", f"file://{d}", f"{tmp_path}//in", f"{tmp_path}/./in", f"{tmp_path}/i*"]
    spark.conf.set("fs.viewfs.mounttable.tiles.link./data", f"file://{d}")
    spellings += [os.path.relpath(d), "viewfs://tiles/data"]
    try:
        for x in spellings:
            assert [r["path"].rsplit("/", 1)[1] for r in readers.list_tiles(spark, x).collect()] == ["a.tif", "b.tif"], x
        spark.conf.set("fs.defaultFS", "viewfs://tiles")  # a path without scheme on another file system
        assert readers.list_tiles(spark, "/data").count() == 2
    finally:
        for name in ("fs.defaultFS", "fs.viewfs.mounttable.tiles.link./data"):
            spark.conf.unset(name)

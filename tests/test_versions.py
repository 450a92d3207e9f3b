"""The store of append-only versions."""

from __future__ import annotations

import os

from gridloom.sources import versions


def rows(spark, *triples):
    return spark.createDataFrame(list(triples), "k int, part string, v double")


def present(spark, path):
    out = versions.read(spark, path, ["k"])
    return sorted(map(tuple, out.select("k", "part", "v").collect()))


def test_newest_version_of_a_key_and_tombstones(spark, tmp_path):
    path = str(tmp_path / "store")
    assert versions.read(spark, path, ["k"]) is None and not versions.compact(spark, path, ["k"])
    versions.append(rows(spark, (1, "a", 1.0), (1, "b", 1.0), (2, "a", 2.0), (None, "n", 0.0)), path)
    versions.append(rows(spark, (1, "c", 9.0)), path)
    versions.append(rows(spark, (3, "a", 3.0)), path, removed=rows(spark, (2, None, None)), key=["k"])
    want = [(1, "c", 9.0), (3, "a", 3.0)]
    assert [r for r in present_all(spark, path) if r[0] is not None] == want and (None, "n", 0.0) in present_all(spark, path)
    assert versions.compact(spark, path, ["k"], waste=0.2)
    assert [r for r in present_all(spark, path) if r[0] is not None] == want
    assert len([n for n in os.listdir(path) if n.startswith(("rows-", "compact-"))]) == 1
    versions.append(rows(spark, (2, "back", 5.0)), path)
    assert (2, "back", 5.0) in present_all(spark, path)


def present_all(spark, path):
    return sorted(map(tuple, versions.read(spark, path, ["k"]).select("k", "part", "v").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_interleaved_writers_lose_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    versions.append(rows(spark, (1, "a", 1.0)), path)
    # a writer that took its number before a compaction, and commits after it
    late = versions._stamp()
    versions.append(rows(spark, (2, "a", 2.0)), path)
    versions.append(rows(spark, (2, "b", 3.0)), path)
    assert versions.compact(spark, path, ["k"], most_folders=1)
    monkeypatch.setattr(versions, "_stamp", lambda: late)
    versions.append(rows(spark, (1, "late", 7.0), (2, "late", 7.0)), path)
    assert present(spark, path) == [(1, "late", 7.0), (2, "b", 3.0)]


def test_unfinished_folders_do_not_count(spark, tmp_path):
    path = str(tmp_path / "store")
    versions.append(rows(spark, (1, "a", 1.0)), path)
    versions.append(rows(spark, (1, "b", 2.0)), path)
    newest = sorted(n for n in os.listdir(path) if n.startswith("rows-"))[-1]
    os.remove(f"{path}/{newest}/_SUCCESS")
    assert present(spark, path) == [(1, "a", 1.0)]
    # a compaction that ended before its entry was written
    rows(spark, (8, "x", 8.0)).selectExpr("*", "'0' AS version", "false AS gone").write.parquet(f"{path}/compact-1")
    assert present(spark, path) == [(1, "a", 1.0)]


def test_a_write_reads_and_rewrites_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    versions.append(rows(spark, *[(i, "a", 1.0) for i in range(50)]), path)
    before = {n: os.stat(f"{path}/{n}").st_mtime_ns for n in os.listdir(path)}
    versions.append(rows(spark, (3, "b", 2.0)), path)
    assert {n: os.stat(f"{path}/{n}").st_mtime_ns for n in before} == before and len(present(spark, path)) == 50

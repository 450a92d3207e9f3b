"""A keyed store of append-only versions.

A write adds one folder and reads nothing, so storing one window costs that window, and writers that run at the same time lose nothing. Rows carry their version;
all rows of a key with the key's newest version are its present rows, and a tombstone is a newest version without rows. Folders count once Spark has committed
them (`_SUCCESS`). Compaction writes the present rows, with their versions, to one folder and then an entry that names the folders it replaces; until the entry
is there nothing changes, and a version that is appended meanwhile is compared by its own number as ever.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = ["version", "gone"]


class Files:
    """The few file operations needed, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.root = path.rstrip("/")
        self.fs = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, below: str = "") -> list[str]:
        at = self.path(f"{self.root}/{below}" if below else self.root)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def has(self, name: str) -> bool:
        return self.fs.exists(self.path(f"{self.root}/{name}"))

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(f"{self.root}/{name}")).getLength()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{name}"), True)


def _stamp() -> str:
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def append(new: DataFrame, path: str, removed: DataFrame | None = None, key: list[str] | None = None) -> str:
    """Add a version: `new` replaces all rows of its keys, the keys of `removed` have none from now on. Returns the version."""
    version = _stamp()
    rows = new.withColumn("gone", F.lit(False))
    if removed is not None:
        rows = rows.unionByName(removed.select(*key, F.lit(True).alias("gone")), allowMissingColumns=True)
    rows.withColumn("version", F.lit(version)).write.parquet(f"{path.rstrip('/')}/rows-{version}")
    return version


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Committed folders that no compaction replaces."""
    files = Files(spark, path)
    there = {n for n in files.names() if n.startswith(("rows-", "compact-")) and files.has(f"{n}/_SUCCESS")}
    entries = [n for n in files.names("_entries") if files.has(f"_entries/{n}/_SUCCESS")]
    replaced, made = set(), set()
    if entries:
        said = spark.read.schema("folder string, replaces array<string>").parquet(*[f"{files.root}/_entries/{n}" for n in entries]).collect()  # a row for each compaction
        for folder, names in sorted(map(tuple, said)):
            if not replaced & set(names):  # of two compactions of the same folder the first counts
                replaced |= set(names)
                made.add(folder)
    return sorted(n for n in there - replaced if n.startswith("rows-") or n in made)


def _all(spark: SparkSession, path: str) -> tuple[DataFrame | None, list[str]]:
    found = _folders(spark, path)
    return (spark.read.option("mergeSchema", "true").parquet(*[f"{path.rstrip('/')}/{n}" for n in found]) if found else None), found


def _newest(rows: DataFrame, key: list[str]) -> DataFrame:
    newest = rows.groupBy(*key).agg(F.max("version").alias("version"))
    same = [rows[c].eqNullSafe(newest[c]) for c in key] + [rows["version"] == newest["version"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return rows.join(newest, on, "left_semi")


def read(spark: SparkSession, path: str, key: list[str]) -> DataFrame | None:
    """The present rows; None if nothing was ever stored."""
    rows, _ = _all(spark, path)
    return None if rows is None else _newest(rows, key).filter("not gone").drop(*MARK)


def compact(spark: SparkSession, path: str, key: list[str], most_folders: int = 64, waste: float = 0.5) -> bool:
    """Rewrite the store if it has more folders than that or if more than that share of its bytes is superseded; returns whether it did."""
    rows, found = _all(spark, path)
    if len(found) < 2:
        return False
    files, name = Files(spark, path), f"compact-{_stamp()}"
    if len(found) <= most_folders:
        size = rows.count()
        if size and _newest(rows, key).count() / size >= 1 - waste:
            return False
    _newest(rows, key).write.parquet(f"{files.root}/{name}")
    entry = spark.createDataFrame([(name, found)], "folder string, replaces array<string>")
    entry.coalesce(1).write.parquet(f"{files.root}/_entries/{name}")
    for old in found:
        files.delete(old)
    return True

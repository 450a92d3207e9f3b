"""Tables that cut lineage: written once to the shared folder, read back with exact sizes.

Iterative jobs and jobs that need one stable placement of rows write their state here. A written
table survives the loss of executors, and its file sizes let the planner choose joins.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder named by the session; a machine-local one only for a local master with none set."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-gridloom-", dir="/tmp")
    return _LOCAL[app]


_OWNED: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    if _OWNED:
        _OWNED[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Tables cut inside are deleted at the end; write the result before it."""
    _OWNED.append([])
    try:
        yield
    finally:
        for path in _OWNED.pop():
            delete(spark, path)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write the rows of `df` once and return a scan of the written table."""
    return StepTable(df, name).df


class StepTable:
    """A written table that an iterative job drops once its successor exists."""

    def __init__(self, df: DataFrame, name: str = "step"):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)

"""Set algebra of sparse masks on the cell key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiling import TILE


def mask_and(a: DataFrame, b: DataFrame, keys: list[str] = TILE) -> DataFrame:
    cell = [*keys, "y", "x"]
    return a.select(*cell).join(b.select(*cell), cell, "left_semi")


def mask_or(a: DataFrame, b: DataFrame, keys: list[str] = TILE) -> DataFrame:
    cell = [*keys, "y", "x"]
    return a.select(*cell).unionByName(b.select(*cell)).distinct()


def mask_minus(a: DataFrame, b: DataFrame, keys: list[str] = TILE) -> DataFrame:
    cell = [*keys, "y", "x"]
    return a.select(*cell).join(b.select(*cell), cell, "left_anti")


def mask_xor(a: DataFrame, b: DataFrame, keys: list[str] = TILE) -> DataFrame:
    """Cells of exactly one mask, by one aggregation."""
    cell = [*keys, "y", "x"]
    marked = a.select(*cell, F.lit(1).alias("_s")).unionByName(b.select(*cell, F.lit(2).alias("_s")))
    return marked.groupBy(*cell).agg(F.bit_or("_s").alias("_s")).filter("_s < 3").select(*cell)

"""Connected components: locally by arrays, globally by contraction of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import local_roots
from ..operators.components import contract

__all__ = ["components", "local_roots"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest id reachable, for every node of an edge table (u, v)."""
    return contract(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v"), []).distinct()

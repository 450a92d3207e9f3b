"""Global order at scale: running totals, ordinals, exact quantiles without a one-task window.

Rows are range-partitioned on the order columns and written once, so a row's slot never changes.
Totals per slot (one row per shuffle partition) are accumulated and added back, so no task ever
holds more than one slot, whatever the size of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut


def running_total(df: DataFrame, order: list[Column], name: str, weight: Column | None = None) -> DataFrame:
    """Add the inclusive running total of an integer `weight` (row count if none) in global order.

    `order` must identify each row, or ties get an arbitrary relative place.
    """
    weight = F.lit(1) if weight is None else weight
    placed = cut(
        df.withColumn("_w", weight.cast("bigint")).repartitionByRange(*order)
        .withColumn("_slot", F.spark_partition_id()), "ordered")
    # one row per shuffle partition: the un-partitioned window and the broadcast are bounded by that number
    slots = placed.groupBy("_slot").agg(F.sum("_w").alias("_slot_w"))
    before = slots.select(
        "_slot", (F.sum("_slot_w").over(Window.orderBy("_slot")) - F.col("_slot_w")).alias("_before"))
    inside = Window.partitionBy("_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("_in", F.sum("_w").over(inside))
        .join(F.broadcast(before), "_slot")
        .withColumn(name, F.col("_before") + F.col("_in"))
        .drop("_slot", "_before", "_in", "_w")
    )


def ordinal(df: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """Consecutive numbers in global order, from `start`."""
    out = running_total(df, order, name)
    return out if start == 1 else out.withColumn(name, F.col(name) + F.lit(start - 1))


def group_ordinal(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Numbers from 1 inside each group, for groups too large for one window task."""
    ranked = running_total(df, [F.col(c) for c in group] + list(order), "_all")
    base = ranked.groupBy(*group).agg((F.min("_all") - 1).alias("_base"))
    return (ranked.join(base, group).withColumn(name, F.col("_all") - F.col("_base"))
            .drop("_all", "_base"))


def exact_quantiles(df: DataFrame, group: list[str], value: str, ranks: dict[str, tuple[str, str]]) -> DataFrame:
    """Exact order statistics per group.

    `ranks` maps an output name to two SQL expressions of the group size `n`; the output is the mean of
    the values at those two ranks (equal expressions give one order statistic). Equal values are counted
    first, so what is ordered is the set of distinct values.
    """
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    order = [F.col(c).asc_nulls_first() for c in group] + [F.col(value)]
    cum = running_total(counts, order, "_hi", F.col("_n")).withColumn("_lo", F.col("_hi") - F.col("_n"))
    sizes = cum.groupBy(*group).agg(F.sum("_n").alias("n"), F.min("_lo").alias("_base"))
    picked = cum.join(sizes, group) if group else cum.join(F.broadcast(sizes))
    lo, hi = F.col("_lo") - F.col("_base"), F.col("_hi") - F.col("_base")
    aggs = []
    for name, pair in ranks.items():
        at = [F.max(F.when((lo < F.expr(r)) & (F.expr(r) <= hi), F.col(value))) for r in pair]
        aggs.append(((at[0] + at[1]) / F.lit(2.0).cast("double")).alias(name))
    return picked.groupBy(*group).agg(*aggs)


MEDIAN = ("floor((n + 1) / 2)", "floor((n + 2) / 2)")


def nearest_rank(percentile: float) -> tuple[str, str]:
    rank = f"greatest(1, ceil(cast({percentile} as double) * n))"
    return rank, rank

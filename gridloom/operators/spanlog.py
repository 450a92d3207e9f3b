"""Span-log analysis: filters, duration statistics with exact order statistics, contributors, exclusions.

Spans have kind, phase, stage, substage, tile, run_id, duration_s. An empty string counts as missing for
tile and substage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordering import MEDIAN, exact_quantiles, nearest_rank

NONE = "<none>"


def has_tile() -> Column:
    return F.col("tile").isNotNull() & (F.col("tile") != "")


def or_none(c: str) -> Column:
    return F.when(F.col(c).isNull() | (F.col(c) == ""), NONE).otherwise(F.col(c))


def filter_spans(df: DataFrame, kinds: list[str], phase: str | None = None, include_tile_null: bool = True, focus: str | None = None) -> DataFrame:
    out = df.filter(F.col("kind").isin(*kinds))
    if phase is not None:
        out = out.filter(F.col("phase") == phase)
    if not include_tile_null:
        out = out.filter(has_tile())
    if focus:
        token = F.lower(F.concat(F.coalesce("stage", F.lit("")), F.lit("::"), F.coalesce("substage", F.lit(""))))
        out = out.filter(F.contains(token, F.lit(focus.lower())))
    return out


def duration_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """count, max, mean, median, min, nearest-rank p90 and total per group; zeros for an empty ungrouped input."""
    d = F.col("duration_s")
    plain = df.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.max(d).alias("max_s"), F.avg(d).alias("mean_s"),
                                F.min(d).alias("min_s"), F.sum(d).alias("total_s"))
    ranks = exact_quantiles(df, by, "duration_s", {"median_s": MEDIAN, "p90_s": nearest_rank(0.9)})
    if by:
        return plain.join(ranks, by)
    return plain.join(F.broadcast(ranks), how="left").fillna(0.0)  # one row each


def by_stage(df: DataFrame) -> DataFrame:
    return duration_stats(df.filter("stage is not null"), ["stage"])


def by_substage(df: DataFrame) -> DataFrame:
    return duration_stats(df.filter("stage is not null").withColumn("substage", or_none("substage")), ["stage", "substage"])


def by_tile(df: DataFrame) -> DataFrame:
    return duration_stats(df.filter(has_tile()), ["tile"])


def hottest(df: DataFrame, tiles: int, k: int = 5) -> DataFrame:
    """Tiles with the largest totals and their k largest contributors; the tile list is a report limit."""
    named = df.filter(has_tile()).withColumn("contributor", F.concat(or_none("stage"), F.lit("::"), or_none("substage")))
    sums = named.groupBy("tile", "contributor").agg(F.sum("duration_s").alias("duration_s"))
    top = (sums.groupBy("tile").agg(F.sum("duration_s").alias("_t")).orderBy(F.desc(F.round("_t", 9)), "tile").limit(tiles))
    w = Window.partitionBy("tile").orderBy(F.desc(F.round("duration_s", 9)), "contributor")
    return (sums.join(F.broadcast(top.select("tile")), "tile", "left_semi")
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("tile", "rank", "contributor", "duration_s"))


def overview(df: DataFrame) -> DataFrame:
    """One row of counts; distinct tiles and runs are counted after a distinct, not in one task."""
    base = df.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("phase").isNull()).alias("null_phase_count"), F.count_if(~F.coalesce(has_tile(), F.lit(False))).alias("null_tile_count"))
    tiles = df.filter(has_tile()).select("tile").distinct().agg(F.count(F.lit(1)).alias("tile_count"))
    runs = df.filter("run_id is not null and run_id <> ''").select("run_id").distinct().agg(F.count(F.lit(1)).alias("run_count"))
    return base.join(F.broadcast(tiles)).join(F.broadcast(runs))  # one row each


def value_counts(df: DataFrame) -> DataFrame:
    """Counts by kind and by phase in long form."""
    kinds = df.select(F.lit("kind").alias("field"), F.coalesce("kind", F.lit("")).alias("value"))
    phases = df.select(F.lit("phase").alias("field"), or_none("phase").alias("value"))
    return kinds.unionByName(phases).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def exclusions(df: DataFrame, kinds: list[str], phase: str | None, include_tile_null: bool) -> DataFrame:
    """How many rows the filters excluded and why, and the kinds selected."""
    sel = F.col("kind").isin(*kinds)
    if phase is not None:
        sel = sel & F.coalesce(F.col("phase") == phase, F.lit(False))
    no_tile = ~F.coalesce(has_tile(), F.lit(False))
    if not include_tile_null:
        sel = sel & ~no_tile
    sel = F.coalesce(sel, F.lit(False))
    other = F.col("phase").isNotNull() & (F.col("phase") != phase) if phase is not None else F.lit(False)
    tile_null = F.lit(False) if include_tile_null else (no_tile if phase is None else no_tile & (F.col("phase") == phase))
    return df.agg(
        F.count_if(~sel).alias("excluded_rows"), F.count_if(~sel & F.col("phase").isNull()).alias("excluded_phase_null"),
        F.count_if(~sel & other).alias("excluded_other_phase"), F.count_if(~sel & tile_null).alias("excluded_tile_null"),
        F.count_if(sel).alias("selected_rows"), F.count_if(sel & (F.col("kind") == "timer")).alias("selected_timer_rows"),
        F.count_if(sel & (F.col("kind") == "span")).alias("selected_span_rows"))


def outlier_tiles(df: DataFrame, stage: str, substage: str) -> DataFrame:
    return by_tile(df.filter((F.col("stage") == stage) & (or_none("substage") == substage)))


def outlier_warning(substages: DataFrame) -> DataFrame:
    """First substage by total whose maximum is at least max(60, 5 x median)."""
    wild = substages.filter(F.col("max_s") >= F.greatest(F.lit(60.0), F.col("median_s") * 5.0))
    return wild.orderBy(F.desc(F.round("total_s", 9)), "stage", "substage").limit(1).select("stage", "substage", "max_s", "median_s")


def rolling_summary(df: DataFrame) -> DataFrame:
    """Running aggregate per (phase, stage, substage)."""
    d = F.col("duration_s")
    return df.groupBy("phase", "stage", "substage").agg(
        F.count(F.lit(1)).alias("count"), F.sum(d).alias("total_s"), F.min(d).alias("min_s"), F.max(d).alias("max_s"), F.avg(d).alias("mean_s"))


def top_by_total(summary: DataFrame, k: int = 5) -> DataFrame:
    order = [F.desc(F.round("total_s", 9)), F.coalesce("phase", F.lit("")), F.col("stage"), F.coalesce("substage", F.lit(""))]
    return summary.orderBy(*order).limit(k)


def tile_total_stats(df: DataFrame) -> DataFrame:
    """Mean, median, minimum and maximum of the per-tile totals."""
    totals = df.filter(has_tile()).groupBy("tile").agg(F.sum("duration_s").alias("total_s"))
    plain = totals.agg(F.avg("total_s").alias("mean_s"), F.min("total_s").alias("min_s"), F.max("total_s").alias("max_s"))
    return plain.join(F.broadcast(exact_quantiles(totals, [], "total_s", {"median_s": MEDIAN})), how="left")  # one row each

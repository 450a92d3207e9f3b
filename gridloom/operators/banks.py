"""Labelled banks, training rows and exact-size samples."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordering import group_ordinal
from ..plans.scratch import cut
from .focal import erode
from .tiling import PATCH, TILE, WINDOW, patch_kind, patch_labels, patch_means, patches

# largest rank for which the optimizer limits groups before the shuffle (its default threshold)
RANK_LIMIT = 1000


def labelled_patches(tiles: DataFrame, cells: DataFrame | None, label: DataFrame, size: int, stride: int, ps: int, thr: float,
                     erosion: int = 0, keys: list[str] = TILE) -> DataFrame:
    """Share and kind of every patch after eroding the label mask; `cells` None stands for every cell of the tiles.

    Whole tiles are counted by blocks of one patch before windows repeat them; only set cells cross the network.
    """
    cell = [*keys, "y", "x"]
    mask = erode(label, tiles, erosion, keys=keys).select(*cell, F.lit(1).alias("label"))
    if cells is None:
        share = patch_means(mask, tiles, ["label"], size, stride, ps, keys).withColumnRenamed("label", "share")
        return patch_kind(share, thr)
    dense = cells.select(*cell).join(mask, cell, "left").fillna(0, ["label"])
    return patch_labels(patches(dense, tiles, size, stride, ps, keys), "label", thr, keys)


def build_bank(features: DataFrame, labels: DataFrame, keys: list[str] = TILE) -> DataFrame:
    """(keys, patch, polarity, vec) of positive and negative patches; tiles without positives are skipped."""
    key = [*keys, *WINDOW, *PATCH]
    marked = labels.filter("kind is not null").select(*key, F.col("kind").alias("polarity"))
    has_pos = marked.filter("polarity = 'pos'").select(*keys).distinct()
    return features.select(*key, "vec").join(marked, key).join(has_pos, keys, "left_semi")


def cap_sample(df: DataFrame, n: int, seed: int, by: list[str], key: list[str]) -> DataFrame:
    """Exactly min(n, group size) rows per group without replacement, in the order of a seeded digest, which any engine can repeat.

    For a small n the rank filter lets every task drop all but n rows per group before the shuffle. A large n would sort a whole
    group in one task, so there groups are counted first, those of n rows or fewer stay as they are, and the ranks of the others come from a
    range-partitioned order.
    """
    order = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed))))
    if n > RANK_LIMIT:
        large = cut(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > n).select(*by), "large")
        if large.isEmpty():
            return df
        match = reduce(and_, [F.col(f"l.{c}").eqNullSafe(F.col(f"d.{c}")) for c in by])
        small = df.alias("d").join(large.alias("l"), match, "left_anti")
        hashed = df.alias("d").join(large.alias("l"), match, "left_semi").withColumn("_h", order)
        return small.unionByName(group_ordinal(hashed, by, [F.col("_h"), *[F.col(c) for c in key]], "_rn").filter(F.col("_rn") <= n).drop("_rn", "_h"))
    w = Window.partitionBy(*by).orderBy(order, *[F.col(c) for c in key])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def combine_sources(parts: list[DataFrame], caps: dict[str, int], seed: int, by: list[str], key: list[str]) -> DataFrame:
    """Bank rows of all tiles and augmentations: caps apply per image and polarity before the union, a polarity without one is whole. Empty input is an error."""
    if not parts:
        raise ValueError("no bank sources")
    out = None
    for part in parts:
        if len(caps) > 1:
            part = cut(part, "source")  # each polarity reads it
        capped = part.filter(~F.col("polarity").isin(list(caps))) if caps else part
        for polarity, n in caps.items():
            piece = cap_sample(part.filter(F.col("polarity") == polarity), n, seed, by, key)
            capped = capped.unionByName(piece)
        out = capped if out is None else out.unionByName(capped)
    return out


def training_rows(features: DataFrame, labels: DataFrame, keys: list[str] = TILE) -> DataFrame:
    """(keys, patch, vec, y) for patches that are clearly positive or negative and have features."""
    key = [*keys, *WINDOW, *PATCH]
    y: Column = F.when(F.col("kind") == "pos", 1.0).otherwise(0.0)
    return labels.filter("kind is not null").select(*key, y.alias("y")).join(features.select(*key, "vec"), key)


def skipped_windows(features: DataFrame, labels: DataFrame, keys: list[str] = TILE) -> DataFrame:
    """Windows with labels but without features."""
    win = [*keys, *WINDOW]
    return labels.select(*win).distinct().join(features.select(*win).distinct(), win, "left_anti")

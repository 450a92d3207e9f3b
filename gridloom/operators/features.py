"""Patch features as grouped aggregates and array expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color, vectors
from .focal import gradient_cols, lbp_code, window_neighbours
from .tiling import PATCH, TILE, WINDOW

EPS = 1e-8


def patch_key(keys: list[str] = TILE) -> list[str]:
    return [*keys, *WINDOW, *PATCH]


def scale01(df: DataFrame, bands: tuple[str, ...] = ("r", "g", "b"), keys: list[str] = TILE) -> DataFrame:
    """Divide by 255 only in windows whose maximum is above 1.5."""
    win = [*keys, *WINDOW]
    top = df.groupBy(*win).agg(F.max(F.greatest(*bands)).cast("double").alias("_top"))
    out = df.join(top, win)
    for c in bands:
        v = F.col(c).cast("double")
        out = out.withColumn(c, F.when(F.col("_top") > 1.5, v / 255.0).otherwise(v))
    return out.drop("_top")


def rgb_stats(df: DataFrame, keys: list[str] = TILE) -> DataFrame:
    return df.groupBy(*patch_key(keys)).agg(*[F.avg(c).alias(f"{c}_mean") for c in "rgb"],
                                            *[F.stddev_pop(c).alias(f"{c}_std") for c in "rgb"])


def hsv_mean(df: DataFrame, keys: list[str] = TILE) -> DataFrame:
    parts = color.hsv(F.col("r"), F.col("g"), F.col("b"))
    return df.groupBy(*patch_key(keys)).agg(*[F.avg(parts[c]).alias(f"{c}_mean") for c in "hsv"])


def with_texture(df: DataFrame, keys: list[str] = TILE) -> DataFrame:
    """Gray value, gradient magnitude and angle, and the local binary pattern, from one pair of window sorts."""
    near = window_neighbours(df.withColumn("gray", color.gray(F.col("r"), F.col("g"), F.col("b"))), "gray", keys)
    g = gradient_cols("gray")
    out = near.withColumn("gy", g["gy"]).withColumn("gx", g["gx"]).withColumn("code", lbp_code("gray"))
    o = color.orientation(F.col("gx"), F.col("gy"))
    return out.withColumn("mag", o["mag"]).withColumn("ori", o["ori"]).drop(
        "n_w", "n_e", "n_n", "n_s", "n_nw", "n_ne", "n_sw", "n_se")


def grad_stats(df: DataFrame, keys: list[str] = TILE) -> DataFrame:
    return df.groupBy(*patch_key(keys)).agg(F.avg("mag").alias("mag_mean"), F.stddev_pop("mag").alias("mag_std"))


def orient_bin(bins: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("ori") / F.lit(2.0 * math.pi) * bins).cast("int")))


def _histogram(df: DataFrame, bin_of: Column, weight: Column, bins: int, keys: list[str]) -> DataFrame:
    """Normalised histogram per patch as an array; one conditional sum per bin, so one shuffle and no empty bins lost."""
    w = [F.sum(F.when(bin_of == k, weight).otherwise(F.lit(0.0))).alias(f"_h{k}") for k in range(bins)]
    total = sum((F.col(f"_h{k}") for k in range(bins)), F.lit(0.0)) + EPS
    return df.groupBy(*patch_key(keys)).agg(*w).select(
        *patch_key(keys), F.array(*[F.col(f"_h{k}") / total for k in range(bins)]).alias("hist"))


def orient_hist(df: DataFrame, bins: int = 8, keys: list[str] = TILE) -> DataFrame:
    return _histogram(df, orient_bin(bins), F.col("mag"), bins, keys)


def lbp_hist(df: DataFrame, bins: int = 16, keys: list[str] = TILE) -> DataFrame:
    return _histogram(df, F.expr(f"cast(code * {bins} div 256 as int)"), F.lit(1.0), bins, keys)


def image_blocks(df: DataFrame, bins: int = 8, lbp_bins: int = 16, keys: list[str] = TILE) -> DataFrame:
    """All image blocks of every patch in one aggregation over textured cells (channels already in [0, 1])."""
    hsv = color.hsv(F.col("r"), F.col("g"), F.col("b"))
    code = F.expr(f"cast(code * {lbp_bins} div 256 as int)")
    aggs = [F.avg(c).alias(f"_m{c}") for c in "rgb"] + [F.stddev_pop(c).alias(f"_s{c}") for c in "rgb"]
    aggs += [F.avg(hsv[c]).alias(f"_v{c}") for c in "hsv"]
    aggs += [F.avg("mag").alias("_gm"), F.stddev_pop("mag").alias("_gs")]
    aggs += [F.sum(F.when(orient_bin(bins) == k, F.col("mag")).otherwise(0.0)).alias(f"_o{k}") for k in range(bins)]
    aggs += [F.sum(F.when(code == k, 1.0).otherwise(0.0)).alias(f"_l{k}") for k in range(lbp_bins)]
    total_o = sum((F.col(f"_o{k}") for k in range(bins)), F.lit(0.0)) + EPS
    total_l = sum((F.col(f"_l{k}") for k in range(lbp_bins)), F.lit(0.0)) + EPS
    return df.groupBy(*patch_key(keys)).agg(*aggs).select(
        *patch_key(keys),
        F.array(*[F.col(f"_m{c}") for c in "rgb"], *[F.col(f"_s{c}") for c in "rgb"]).alias("rgb_stats"),
        F.array(*[F.col(f"_v{c}") for c in "hsv"]).alias("hsv_mean"),
        F.array("_gm", "_gs").alias("grad_stats"),
        F.array(*[F.col(f"_o{k}") / total_o for k in range(bins)]).alias("grad_orient_hist"),
        F.array(*[F.col(f"_l{k}") / total_l for k in range(lbp_bins)]).alias("lbp_hist"))


def ingest_embeddings(df: DataFrame, tokens: str, n_prefix: int, layers: list[int] | None = None) -> DataFrame:
    """Patch vectors from token lists: drop leading tokens, optionally average layers, unit length.

    `tokens` is ARRAY<ARRAY<ARRAY<number>>> (layer, token, channel).
    """
    all_layers = F.col(tokens)
    used = [F.element_at(all_layers, -1)] if not layers else [F.element_at(all_layers, k + 1) for k in layers]
    kept = [F.slice(t, n_prefix + 1, F.greatest(F.size(t) - n_prefix, F.lit(0))) for t in used]
    total = F.transform(kept[0], vectors.to_double)
    for t in kept[1:]:
        total = F.zip_with(total, t, lambda a, b: F.zip_with(a, vectors.to_double(b), lambda x, y: x + y))
    mean = F.transform(total, lambda v: F.transform(v, lambda x: x / float(len(kept))))
    rest = [c for c in df.columns if c != tokens]
    return df.select(*rest, F.posexplode(mean).alias("patch", "_v")).select(*rest, "patch", vectors.l2(F.col("_v")).alias("vec"))


# fixed values: default block weights per consumer
KNN_WEIGHTS = {"embedding": 1.0, "rgb_stats": 0.5, "hsv_mean": 0.4, "grad_stats": 0.6, "grad_orient_hist": 0.6, "lbp_hist": 0.4}
TREE_WEIGHTS = {"embedding": 1.0, "rgb_stats": 1.0, "hsv_mean": 0.8, "grad_stats": 1.0, "grad_orient_hist": 1.0, "lbp_hist": 0.8}


def fuse_blocks(df: DataFrame, weights: dict[str, float], unit: bool, base: str = "embedding") -> DataFrame:
    """Weighted concatenation of the enabled blocks (weight above zero) into `vec`; the base block alone if none is."""
    used = {k: w for k, w in weights.items() if w > 0 and k in df.columns}
    vec = vectors.concat_all([vectors.scale(F.col(k), w) for k, w in used.items()]) if used else vectors.to_double(F.col(base))
    out = df.withColumn("vec", vec)
    return out.withColumn("vec", vectors.l2(F.col("vec"))) if unit and used else out


def zscore_fit(df: DataFrame, vec: str = "vec", eps: float = 1e-6) -> DataFrame:
    """One row of per-dimension means and population deviations (floored); fails on no rows.

    Sums are taken per dimension with map-side aggregation; only one row per dimension is gathered.
    """
    dims = df.select(F.posexplode(vectors.to_double(F.col(vec))).alias("dim", "v")).groupBy("dim").agg(
        F.avg("v").alias("mean"), F.greatest(F.stddev_pop("v"), F.lit(float(eps))).alias("std"), F.count("v").alias("n"))
    stats = dims.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("_s"),
                     F.min("n").alias("_lo"), F.max("n").alias("_hi"))
    ok = F.when(F.size("_s") == 0, F.raise_error(F.lit("no rows to fit on"))).when(
        F.col("_lo") != F.col("_hi"), F.raise_error(F.lit("vectors differ in length"))).otherwise(F.col("_s"))
    return stats.select(F.transform(ok, lambda s: s["mean"]).alias("mean"), F.transform(ok, lambda s: s["std"]).alias("std"))


def zscore_apply(df: DataFrame, stats: DataFrame, vec: str = "vec") -> DataFrame:
    """Standardise with a one-row stats table; a dimension mismatch is an error."""
    out = df.join(F.broadcast(stats.select(F.col("mean").alias("_mean"), F.col("std").alias("_std"))))
    good = F.when(F.size(vec) != F.size("_mean"), F.raise_error(F.lit("dimension mismatch")).cast("array<double>")).otherwise(
        vectors.zscore(F.col(vec), F.col("_mean"), F.col("_std")))
    return out.withColumn(vec, good).drop("_mean", "_std")


def missing_features(windows: DataFrame, store: DataFrame, keys: list[str] = TILE) -> DataFrame:
    """Windows without valid stored features."""
    return windows.join(store.select(*keys, *WINDOW).distinct(), [*keys, *WINDOW], "left_anti")


def hit_ratio(windows: DataFrame, store: DataFrame, keys: list[str] = TILE) -> DataFrame:
    win = [*keys, *WINDOW]
    have = store.select(*win).distinct().withColumn("_hit", F.lit(1))
    return (windows.join(have, win, "left").agg(F.count("_hit").alias("cached"), F.count(F.lit(1)).alias("_all"))
            .select("cached", (F.col("_all") - F.col("cached")).alias("computed"),
                    (F.col("cached") / F.greatest(F.lit(1), F.col("_all"))).alias("hit_ratio")))

"""Parameter searches as keyed sweeps: each candidate is a key of one plan, never a driver loop over cells."""

from __future__ import annotations

import warnings
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from .focal import dilate
from .metrics import confusion, first_best, joint_sweep, sweep, threshold_rank, weighted_mean, weighted_or_zero, weighted_sweep
from .refine import KERNEL_PARAMS, PairwiseConfig, pairwise_refine
from .tiling import TILE


def k_threshold_grid(topk: DataFrame, ks: list[int], thresholds: list[float], gt: str = "gt", image: list[str] | None = None) -> DataFrame:
    """First best (k, threshold) on the mean of the k best similarities of each patch.

    `topk` has one row per patch and rank with `sim`; patches are identified by `query_id`.
    """
    image = image or []
    wide = topk.groupBy(*image, "query_id", gt).agg(
        *[F.avg(F.when(F.col("rank") <= k, F.col("sim"))).alias(f"_k{i}") for i, k in enumerate(ks)])
    long = wide.select(*image, gt, F.explode(F.array(*[
        F.struct(F.lit(i).alias("k_ord"), F.lit(k).alias("k"), F.col(f"_k{i}").alias("score")) for i, k in enumerate(ks)])).alias("_c")
    ).select(*image, gt, "_c.*")
    swept = sweep(long, F.col("score"), thresholds, [*image, "k_ord", "k"], gt=gt)
    return first_best(swept, "iou", ["k_ord", "thr_idx"], image)


def select_penalty(cells: DataFrame, penalties: list[float], thresholds: list[float], weights: DataFrame, keys: list[str] = TILE) -> DataFrame:
    """Roads penalty, stream and configuration of the highest weighted IoU.

    `cells` is long: tile keys, `stream` ('raw' or 'xgb'), `cand_ord`, `score`, `gt`, `buffer`, `road`. Per penalty the first
    best candidate of each stream competes; 'raw' wins a tie; the first best penalty wins.
    """
    ordered = sorted(set(float(t) for t in thresholds))
    place = lambda p: F.when(F.col("buffer"), threshold_rank(F.when(F.col("road"), F.col("score") * F.lit(float(p))).otherwise(F.col("score")), ordered)).otherwise(F.lit(0))
    ranks = {f"_r{i}": place(p) for i, p in enumerate(penalties)}
    settings = [({"pen_ord": i, "penalty": float(p)}, F.col(f"_r{i}")) for i, p in enumerate(penalties)]
    by = ["pen_ord", "penalty", "stream", "cand_ord"]
    swept = joint_sweep(cells, ranks, settings, thresholds, [*keys, "stream", "cand_ord"])
    mean = weighted_sweep(swept, weights, keys, by)
    per_stream = first_best(mean, "iou", ["cand_ord", "thr_idx"], ["pen_ord", "penalty", "stream"])
    champion = first_best(per_stream, "iou", ["stream"], ["pen_ord", "penalty"])
    return first_best(champion, "iou", ["pen_ord"])


def _sum_ranks(weight_sets: list[tuple[float, float, float]], thresholds: list[float]) -> dict[str, Column]:
    """The threshold rank of the weighted channel sum under each set of weights."""
    ordered = sorted(set(float(t) for t in thresholds))
    return {f"_w{i}": threshold_rank(scores.weighted_rgb(tuple(F.lit(float(x)) for x in w), F.col("r"), F.col("g"), F.col("b")), ordered) for i, w in enumerate(weight_sets)}


def shadow_grid(cells: DataFrame, weight_sets, thresholds: list[float], keys: list[str] = TILE) -> DataFrame:
    """First best weights and threshold per tile, counted only under the base mask; tiles without base cells give no row.

    `cells` holds only cells of the base mask with r, g, b and gt.
    """
    settings = [({"w_ord": i}, F.col(f"_w{i}")) for i in range(len(weight_sets))]
    swept = joint_sweep(cells, _sum_ranks(weight_sets, thresholds), settings, thresholds, keys)
    return first_best(swept, "iou", ["w_ord", "thr_idx"], keys)


def tune_shadow(cells: DataFrame, weight_sets, thresholds: list[float], protects: list[float], weights: DataFrame,
                keys: list[str] = TILE) -> DataFrame:
    """First best (weights, threshold, protect score) by weighted IoU over tiles; a protected cell is always kept."""
    guards = sorted(set(float(p) for p in protects))
    top = F.lit(len(set(float(t) for t in thresholds)))
    ranks = {**_sum_ranks(weight_sets, thresholds), "_guard": threshold_rank(F.col("score"), guards)}
    settings = [({"w_ord": i, "p_ord": j, "protect": float(p)}, F.when(F.col("_guard") > guards.index(float(p)), top).otherwise(F.col(f"_w{i}")))
                for i in range(len(weight_sets)) for j, p in enumerate(protects)]
    by = ["w_ord", "p_ord", "protect"]
    joined = joint_sweep(cells, ranks, settings, thresholds, keys).join(weights.select(*keys, "weight"), keys)
    mean = joined.groupBy(*by, "thr_idx", "threshold").agg(
        weighted_or_zero(F.col("iou"), F.col("weight")).alias("iou"), F.sum("weight").alias("_w")).filter("_w > 0").drop("_w")
    return first_best(mean, "iou", ["w_ord", "thr_idx", "p_ord"])


def crf_candidates(values: dict[str, list], max_configs: int | None = None) -> list[dict]:
    """Cartesian grid in nested order (softness, band, position, bilateral parameters); with `max_configs` the first ones, and a warning that says how many go."""
    names = ["prob_softness", "trimap_band", *KERNEL_PARAMS]
    found = [dict(zip(names, combo)) for combo in product(*[values[n] for n in names])]
    if max_configs is not None and len(found) > max_configs:
        warnings.warn(f"{len(found) - max_configs} of {len(found)} settings are left out", stacklevel=2)
    return found[:max_configs]


def crf_grid(cells: DataFrame, tiles: DataFrame, configs: list[dict], center: float, weights: DataFrame, steps: int = 5,
             keys: list[str] = TILE) -> DataFrame:
    """First refinement setting with the highest weighted IoU: all settings run in one plan, the setting is a key.

    `cells` is dense with r, g, b, score and boolean gt and buffer.
    """
    cell = [*keys, "y", "x"]
    rows = F.array(*[F.struct(F.lit(i).alias("cfg_ord"), *[F.lit(float(c[n])).alias(n) for n in c]) for i, c in enumerate(configs)])
    long = cells.withColumn("_c", F.explode(rows)).select(*cell, "r", "g", "b", "score", "gt", "buffer", "_c.*")
    seed = (F.col("score") >= center) & F.col("buffer")
    p = F.when(F.col("trimap_band") > 0, F.lit(None)).otherwise(_logistic(F.col("score"), center, F.col("prob_softness")))
    bands = sorted({int(c["trimap_band"]) for c in configs if c["trimap_band"] > 0})
    long = long.withColumn("seed", seed)
    if bands:
        base = cells.filter(seed).select(*cell)
        wide = None
        for band in bands:
            part = dilate(base, tiles, band, "ellipse", keys).withColumn("trimap_band", F.lit(float(band))).withColumn("wide", F.lit(True))
            wide = part if wide is None else wide.unionByName(part)
        long = long.join(wide, [*cell, "trimap_band"], "left")
        p = F.coalesce(p, scores.trimap(F.col("seed"), F.coalesce("wide", F.lit(False))))
    p = F.when(F.col("buffer"), scores.clip01(p)).otherwise(F.lit(scores.CLIP))
    keyed = [*keys, "cfg_ord"]
    refined = pairwise_refine(long.withColumn("p", p), PairwiseConfig(steps=steps), keyed, max((float(c[n]) for c in configs for n in ("pos_xy_std", "bilateral_xy_std") if n in c), default=None))
    judged = refined.join(cells.select(*cell, "gt"), cell)
    per_tile = confusion(judged, F.col("mask"), F.col("gt"), keyed).join(weights.select(*keys, "weight"), keys)
    return first_best(per_tile.groupBy("cfg_ord").agg(weighted_mean(F.col("iou"), F.col("weight")).alias("iou")), "iou", ["cfg_ord"])


def _logistic(score: Column, center: float, softness: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-(score - F.lit(float(center))) / softness))

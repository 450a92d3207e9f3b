"""Object proposals: candidate cells, object metrics, staged rules, accepted masks.

An object is (tile keys, zone, root). Costly shape metrics are computed only for objects that pass the cheap
rules (semi join before the iterative jobs), plus the objects inside the buffer, which are accepted without rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..plans.ordering import group_ordinal
from ..plans.scratch import cut
from .components import distance_to_background, rooted_cells, skeleton
from .focal import inner_boundary
from .tiling import TILE


@dataclass(frozen=True)
class ProposalConfig:
    min_area_px: float = 100
    min_length_m: float = 15.0
    max_width_m: float = 10.0
    min_skeleton_ratio: float = 8.0
    min_pca_ratio: float = 3.0
    width_bonus_per_pca: float = 1.0
    hard_width_cap_m: float = 20.0
    max_circularity: float = 0.30
    min_mean_score: float = 0.2
    max_road_overlap: float = 0.8
    connectivity: int = 2
    enabled: bool = True


# fixed values: rules in report order; the first four listed in CHEAP are evaluated first
RULES = ["min_area_px", "min_length_m", "max_width_m", "min_skeleton_ratio", "min_pca_ratio", "max_circularity",
         "min_mean_score", "max_road_overlap"]
CHEAP = ["min_area_px", "min_pca_ratio", "min_mean_score", "max_road_overlap"]
INSIDE, OUTSIDE = "inside_buffer_auto", "outside_evaluated"
# fixed value: a measure this near its limit meets it, so that the order of sums and the last bits of roots decide no rule
TIE = 1e-9


def object_key(keys: list[str] = TILE) -> list[str]:
    return [*keys, "zone", "root"]


def candidates(source: DataFrame, label: DataFrame, buffer: DataFrame, scope: DataFrame | None = None, keys: list[str] = TILE) -> DataFrame:
    """Source cells in scope and not labelled, with their zone."""
    cell = [*keys, "y", "x"]
    out = source.select(*cell).join(label.select(*cell), cell, "left_anti")
    if scope is not None:
        out = out.join(scope.select(*cell), cell, "left_semi")
    inside = buffer.select(*cell, F.lit(True).alias("_in"))
    return out.join(inside, cell, "left").select(*cell, F.when(F.col("_in"), INSIDE).otherwise(OUTSIDE).alias("zone"))


def objects(cand: DataFrame, conn: int = 2, keys: list[str] = TILE) -> DataFrame:
    """Candidate cells with the root of their object; zones never touch each other."""
    return rooted_cells(cand, conn, [*keys, "zone"])


def pca_ratio() -> Column:
    """Ratio of the eigenvalues of the sample covariance of the aggregated cells (floored at 1e-8)."""
    a, d, b = F.var_samp("y"), F.var_samp("x"), F.covar_samp("y", "x")
    mid, half = (a + d) / 2.0, F.sqrt(((a - d) / 2.0) * ((a - d) / 2.0) + b * b)
    ratio = F.greatest(mid + half, F.lit(1e-8)) / F.greatest(mid - half, F.lit(1e-8))
    return F.when(F.count(F.lit(1)) < 2, F.lit(1.0)).otherwise(ratio)


def basic_metrics(cells: DataFrame, key: list[str]) -> DataFrame:
    """Area, centroid, mean score, road overlap and elongation; `cells` has score and boolean road."""
    return cells.groupBy(*key).agg(
        F.count(F.lit(1)).cast("double").alias("area_px"), F.avg("y").alias("centroid_row"), F.avg("x").alias("centroid_col"),
        F.avg("score").alias("mean_score"), F.avg(F.col("road").cast("double")).alias("road_overlap"), pca_ratio().alias("pca_ratio"))


def shape_metrics(cells: DataFrame, key: list[str], pixel_m: float) -> DataFrame:
    """Perimeter, circularity, skeleton length, mean width and their ratio."""
    cells = cut(cells.select(*key, "y", "x"), "shape")
    area = cells.groupBy(*key).agg(F.count(F.lit(1)).alias("_area"))
    edge = inner_boundary(cells, key).groupBy(*key).agg(F.count(F.lit(1)).alias("_edge"))
    thin = cut(skeleton(cells, key), "thin")
    lengths = thin.groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias("length_px"))
    widths = distance_to_background(cells, thin, key).groupBy(*key).agg((F.avg("dist") * 2.0).alias("mean_width_px"))
    out = (area.join(edge, key, "left").join(lengths, key, "left").join(widths, key, "left")
           .fillna(0.0, ["length_px", "mean_width_px"]).fillna(0, ["_edge"]))
    p = F.col("_edge").cast("double")
    return out.select(
        *key, p.alias("perimeter_px"), (F.lit(4.0 * math.pi) * F.col("_area") / (p * p + 1e-8)).alias("circularity"),
        "length_px", (F.col("length_px") * pixel_m).alias("length_m"), "mean_width_px",
        (F.col("mean_width_px") * pixel_m).alias("mean_width_m"),
        (F.col("length_px") / F.greatest(F.col("mean_width_px"), F.lit(1e-6))).alias("skeleton_ratio"))


def cheap_checks(df: DataFrame, cfg: ProposalConfig) -> DataFrame:
    return (df.withColumn("min_area_px", F.col("area_px") >= float(cfg.min_area_px))
            .withColumn("min_pca_ratio", F.col("pca_ratio") >= float(cfg.min_pca_ratio) - TIE)
            .withColumn("min_mean_score", F.col("mean_score") >= float(cfg.min_mean_score) - TIE)
            .withColumn("max_road_overlap", F.col("road_overlap") <= float(cfg.max_road_overlap) + TIE))


def cheap_pass() -> Column:
    return F.col(CHEAP[0]) & F.col(CHEAP[1]) & F.col(CHEAP[2]) & F.col(CHEAP[3])


def checks(df: DataFrame, cfg: ProposalConfig) -> DataFrame:
    """All eight rules on a table of basic and (where evaluated) shape metrics; rules without shape stay false."""
    width = scores.allowed_width(F.col("pca_ratio"), cfg.max_width_m, cfg.min_pca_ratio, cfg.width_bonus_per_pca, cfg.hard_width_cap_m)
    ok = cheap_pass() & F.col("length_px").isNotNull()
    out = cheap_checks(df, cfg)

    def rule(cond: Column) -> Column:
        return F.coalesce(ok & cond, F.lit(False))

    return (out.withColumn("allowed_width_m", F.when(ok & (F.col("zone") == OUTSIDE), width))
            .withColumn("min_length_m", rule(F.col("length_m") >= float(cfg.min_length_m) - TIE))
            .withColumn("max_width_m", rule(F.col("mean_width_m") <= width + TIE))
            .withColumn("min_skeleton_ratio", rule(F.col("skeleton_ratio") >= float(cfg.min_skeleton_ratio) - TIE))
            .withColumn("max_circularity", rule(F.col("circularity") <= float(cfg.max_circularity) + TIE)))


def accept(df: DataFrame, keys: list[str] = TILE) -> DataFrame:
    """Verdict per object: inside ones pass with score 1; others need every rule. Ids count inside objects first."""
    inside = F.col("zone") == INSIDE
    passed = sum((F.col(r).cast("int") for r in RULES), F.lit(0))
    failed = F.filter(F.array(*[F.when(~F.col(r), F.lit(r)) for r in RULES]), lambda s: s.isNotNull())
    none = F.slice(F.array(F.lit("")), 1, 0)
    out = (df.withColumn("accepted", inside | (passed == len(RULES)))
           .withColumn("acceptance_score", F.when(inside, 1.0).otherwise(passed / float(len(RULES))))
           .withColumn("reject_reasons", F.when(inside, none).otherwise(failed)))
    return group_ordinal(out, keys, [F.col("zone"), F.col("root")], "component_id")


def evaluate(cells: DataFrame, cfg: ProposalConfig, pixel_m: float, keys: list[str] = TILE) -> DataFrame:
    """Objects with metrics, rules and verdicts; `cells` has zone, root, score and road."""
    key = object_key(keys)
    cells = cut(cells, "object-cells")
    basic = cut(cheap_checks(basic_metrics(cells, key), cfg), "basic")
    full = basic.filter((F.col("zone") == INSIDE) | cheap_pass()).select(*key)
    shape = shape_metrics(cells.join(full, key, "left_semi"), key, pixel_m)
    both = basic.drop(*CHEAP).join(shape, key, "left")
    return accept(checks(both, cfg), keys)


def proposal_masks(cells: DataFrame, verdicts: DataFrame, cfg: ProposalConfig, keys: list[str] = TILE) -> DataFrame:
    """Long table (variant, tile, y, x) of candidate, accepted, rejected and evaluated cells."""
    key = object_key(keys)
    inside = F.col("zone") == INSIDE
    if not cfg.enabled:
        names = [F.lit("candidate_mask"), F.when(inside, "candidate_inside_mask").otherwise("candidate_outside_mask")]
        joined = cells
    else:
        joined = cells.join(verdicts.select(*key, "accepted"), key)
        ok = F.col("accepted")
        names = [
            F.lit("candidate_mask"), F.when(inside, "candidate_inside_mask").otherwise("candidate_outside_mask"),
            F.when(~inside, "evaluated_outside_mask"), F.when(ok & inside, "accepted_inside_mask"),
            F.when(ok & ~inside, "accepted_outside_mask"), F.when(ok, "accepted_mask"), F.when(~ok, "rejected_mask")]
    return (joined.select(*keys, "y", "x", F.explode(F.array(*names)).alias("variant")).filter("variant is not null")
            .select("variant", *keys, "y", "x"))


def with_proposals(mask: DataFrame, accepted: DataFrame, keys: list[str] = TILE) -> DataFrame:
    cell = [*keys, "y", "x"]
    return mask.select(*cell).unionByName(accepted.select(*cell)).distinct()

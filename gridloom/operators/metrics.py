"""Confusion counts, one-pass threshold sweeps, weighted summaries and first-best selection.

A scored table has the tile keys, a score and boolean `gt` and `buffer` columns, one row per cell. Ratios carry
1e-8 in the denominator. The first maximum wins, so every grid dimension carries an ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tiling import TILE

EPS = 1e-8
RATIOS = ["precision", "recall", "iou", "f1"]


def with_ratios(df: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    out = (df.withColumn("precision", tp / (tp + fp + EPS)).withColumn("recall", tp / (tp + fn + EPS))
           .withColumn("iou", tp / (tp + fp + fn + EPS)))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", 2.0 * p * r / (p + r + EPS))


def confusion(df: DataFrame, pred: Column, gt: Column, keys: list[str] = TILE) -> DataFrame:
    """Counts and ratios of a dense table; `keys` may be empty for one global row."""
    def n(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0)).cast("bigint")

    return with_ratios(df.groupBy(*keys).agg(
        n(pred & gt).alias("tp"), n(pred & ~gt).alias("fp"), n(~pred & gt).alias("fn"), n(~pred & ~gt).alias("tn")))


def mask_confusion(pred: DataFrame, gt: DataFrame, tiles: DataFrame, keys: list[str] = TILE) -> DataFrame:
    """Counts and ratios of two sparse masks; true negatives come from the tile area."""
    cell = [*keys, "y", "x"]
    both = (pred.select(*cell, F.lit(1).alias("p"), F.lit(0).alias("g"))
            .unionByName(gt.select(*cell, F.lit(0).alias("p"), F.lit(1).alias("g")))
            .groupBy(*cell).agg(F.max("p").alias("p"), F.max("g").alias("g")))
    counts = both.groupBy(*keys).agg(
        F.sum(F.expr("p * g")).alias("tp"), F.sum(F.expr("p * (1 - g)")).alias("fp"), F.sum(F.expr("(1 - p) * g")).alias("fn"))
    area = tiles.select(*keys, (F.col("height").cast("bigint") * F.col("width")).alias("_area"))
    full = area.join(counts, keys, "left").fillna(0, ["tp", "fp", "fn"])
    return with_ratios(full.withColumn("tn", F.col("_area") - F.col("tp") - F.col("fp") - F.col("fn")).drop("_area")
                       .select(*keys, "tp", "fp", "fn", "tn"))


def threshold_rank(score: Column, thresholds: list[float]) -> Column:
    """Number of ascending thresholds not above the score, as a balanced CASE tree (log n comparisons)."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(score >= F.lit(float(thresholds[mid])), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(thresholds))


def sweep(df: DataFrame, score: Column, thresholds: list[float], keys: list[str] = TILE, gt: str = "gt",
          keep: Column | None = None, always: Column | None = None) -> DataFrame:
    """Confusion at every threshold in one pass over the cells.

    Cells are counted by threshold rank (`keep` false ranks 0, `always` true ranks last), then counts are accumulated
    in rank order. The cost does not depend on the number of thresholds; a window holds at most thresholds + 1 rows.
    """
    ordered = sorted(set(float(t) for t in thresholds))
    rank = threshold_rank(score, ordered)
    if always is not None:
        rank = F.when(always, F.lit(len(ordered))).otherwise(rank)
    if keep is not None:
        rank = F.when(keep, rank).otherwise(F.lit(0))
    hit = F.col(gt).cast("bigint")
    counts = df.select(*keys, rank.alias("_r"), hit.alias("_p"), (1 - hit).alias("_n")).groupBy(*keys, "_r").agg(
        F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    return accumulated(counts, thresholds, keys)


def joint_sweep(df: DataFrame, ranks: dict[str, Column], settings: list[tuple[dict, Column]], thresholds: list[float], keys: list[str] = TILE, gt: str = "gt") -> DataFrame:
    """Confusion at every threshold for several settings at once, from one joint histogram of the cells.

    `ranks` are the columns that a cell's outcome depends on (threshold ranks, flags); cells are counted by all of them together, before any setting is looked at. A
    setting is its labels and the rank that it gives to a combination, as an expression of the names in `ranks`. Only combinations are repeated for each setting.
    """
    hit = F.col(gt).cast("bigint")
    joint = df.select(*keys, *[c.alias(n) for n, c in ranks.items()], hit.alias("_p"), (1 - hit).alias("_n")).groupBy(*keys, *ranks).agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    labels = list(settings[0][0])
    options = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in own.items()], rank.cast("int").alias("_r")) for own, rank in settings])
    counts = joint.select(*keys, "_p", "_n", F.explode(options).alias("_s")).groupBy(*keys, *[F.col(f"_s.{c}").alias(c) for c in labels], F.col("_s._r").alias("_r")).agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    return accumulated(counts, thresholds, [*keys, *labels])


def accumulated(counts: DataFrame, thresholds: list[float], keys: list[str]) -> DataFrame:
    """Confusion at every threshold from counts by threshold rank (`_r`; `_p` true, `_n` false)."""
    ordered = sorted(set(float(t) for t in thresholds))
    # each counted rank answers for all thresholds above the previous counted one; the last also for those nobody reached
    w = Window.partitionBy(*keys).orderBy("_r")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = counts.select(
        *keys, "_r", F.sum("_p").over(every).alias("_P"), F.sum("_n").over(every).alias("_N"),
        F.coalesce(F.sum("_p").over(past), F.lit(0)).alias("_below_p"), F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_below_n"),
        F.coalesce(F.lag("_r").over(w), F.lit(-1)).alias("_prev"), F.lead("_r").over(w).isNull().alias("_last"))
    top = F.lit(len(ordered))
    pieces = F.array(
        F.struct(F.sequence(F.col("_prev") + 1, F.col("_r")).alias("at"), (F.col("_P") - F.col("_below_p")).alias("tp"), (F.col("_N") - F.col("_below_n")).alias("fp")),
        F.when(F.col("_last") & (F.col("_r") < top), F.struct(
            F.sequence(F.least(F.col("_r") + 1, top), top).alias("at"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"))))
    cum = (steps.select(*keys, "_P", "_N", F.explode(pieces).alias("_c")).filter("_c is not null")
           .select(*keys, "_P", "_N", "_c.tp", "_c.fp", F.explode("_c.at").alias("_r")).filter("_r > 0"))
    # original positions, so that the first of equal values keeps its place
    rows = F.array(*[F.struct(F.lit(ordered.index(float(t)) + 1).alias("r"), F.lit(i).alias("thr_idx"), F.lit(float(t)).alias("threshold"))
                     for i, t in enumerate(thresholds)])
    out = cum.withColumn("_t", F.explode(F.filter(rows, lambda s: s["r"] == F.col("_r"))))
    return with_ratios(out.select(
        *keys, F.col("_t.thr_idx").alias("thr_idx"), F.col("_t.threshold").alias("threshold"), "tp", "fp",
        (F.col("_P") - F.col("tp")).alias("fn"), (F.col("_N") - F.col("fp")).alias("tn")))


def first_best(df: DataFrame, by: str, ordinals: list[str], keys: list[str] | None = None) -> DataFrame:
    """Row with the highest `by`; the smallest ordinals decide ties. An aggregate, so it combines before the shuffle."""
    keys = keys or []
    rest = [c for c in df.columns if c not in keys]
    # rounding makes ties independent of the order of floating sums
    lead = [(-F.round(F.col(by), 12)).alias("_neg"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(ordinals)]]
    best = df.groupBy(*keys).agg(F.min(F.struct(*lead, *[F.col(c) for c in rest])).alias("_b"))
    return best.filter("_b is not null").select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def weighted_mean(x: Column, w: Column) -> Column:
    """Sum(w x) / Sum(w); the plain mean when the weights do not sum above zero; 0 without rows."""
    return F.when(F.sum(w) > 0, F.sum(x * w) / F.sum(w)).otherwise(F.coalesce(F.avg(x), F.lit(0.0)))


def weighted_or_zero(x: Column, w: Column) -> Column:
    return F.when(F.sum(w) > 0, F.sum(x * w) / F.sum(w)).otherwise(F.lit(0.0))


def weighted_sweep(per_tile: DataFrame, weights: DataFrame, keys: list[str] = TILE, by: list[str] | None = None) -> DataFrame:
    """Weighted mean of the ratios per threshold over tiles; zeros when the weights do not sum above zero."""
    by = by or []
    joined = per_tile.join(weights.select(*keys, "weight"), keys)
    return joined.groupBy(*by, "thr_idx", "threshold").agg(
        *[weighted_or_zero(F.col(c), F.col("weight")).alias(c) for c in ("iou", "f1", "precision", "recall")])


def best_threshold(swept: DataFrame) -> DataFrame:
    return first_best(swept, "iou", ["thr_idx"])


def around(base: float, step: float, window: float) -> list[float]:
    """Thresholds from base - window to base + window, clipped to [0, 1]."""
    lo, hi = max(0.0, base - window), min(1.0, base + window)
    n = int(round((hi - lo) / step))
    return [round(lo + i * step, 12) for i in range(n + 1) if lo + i * step <= hi + 1e-12]


def fine_tune(df: DataFrame, score: Column, base: float, step: float, window: float, keys: list[str] = TILE,
              keep: Column | None = None) -> DataFrame:
    """First best threshold near `base` for each tile."""
    return first_best(sweep(df, score, around(base, step, window), keys, keep=keep), "iou", ["thr_idx"], keys)


# fixed values: stages in report order
STAGES = ["knn_raw", "knn_crf", "knn_shadow", "xgb_raw", "xgb_crf", "xgb_shadow", "champion_raw", "champion_crf", "champion_shadow"]


def stage_metrics(df: DataFrame, stages: list[str], gt: str, keys: list[str] = TILE) -> DataFrame:
    """Confusion per tile and stage from boolean mask columns, with the ground-truth size as weight.

    All stages are counted in one aggregation, then unpivoted: no cell is repeated per stage.
    """
    g = F.col(gt)

    def n(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0)).cast("bigint")

    aggs = []
    for s in stages:
        p = F.col(s)
        aggs.append(F.struct(F.lit(s).alias("stage"), n(p & g).alias("tp"), n(p & ~g).alias("fp"), n(~p & g).alias("fn"),
                             n(~p & ~g).alias("tn")).alias(f"_{s}"))
    wide = df.groupBy(*keys).agg(n(g).cast("double").alias("weight"), *aggs)
    return with_ratios(wide.select(*keys, "weight", F.explode(F.array(*[F.col(f"_{s}") for s in stages])).alias("_s"))
                       .select(*keys, "weight", "_s.*"))


def stage_order(stage: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage).cast("int")


def stage_summary(df: DataFrame) -> DataFrame:
    """Weighted means and exact medians per stage, in report order."""
    from ..plans.ordering import MEDIAN, exact_quantiles
    from ..plans.scratch import cut

    df = cut(df.select("stage", "weight", *RATIOS), "stages")  # a row for each tile and stage, read three times; what it comes from is not counted again
    means = df.groupBy("stage").agg(
        *[weighted_mean(F.col(c), F.col("weight")).alias(f"{c}_wmean") for c in ("iou", "f1", "precision", "recall")])
    for c in ("iou", "f1"):
        means = means.join(exact_quantiles(df, ["stage"], c, {f"{c}_median": MEDIAN}), "stage")
    return means.withColumn("stage_ord", stage_order(F.col("stage")))


def stage_delta(df: DataFrame) -> DataFrame:
    """Change of weighted IoU and F1 along champion raw, crf, shadow (three rows at most in the window)."""
    chain = df.filter(F.col("stage").startswith("champion_")).groupBy("stage").agg(
        *[weighted_mean(F.col(c), F.col("weight")).alias(c) for c in ("iou", "f1")])
    w = Window.orderBy("_o")
    out = chain.withColumn("_o", stage_order(F.col("stage")))
    return (out.select(F.lag("stage").over(w).alias("stage_from"), F.col("stage").alias("stage_to"),
                       (F.col("iou") - F.lag("iou").over(w)).alias("d_iou"), (F.col("f1") - F.lag("f1").over(w)).alias("d_f1"))
            .filter("stage_from is not null"))


def mean_std(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    aggs = []
    for c in ("iou", "f1", "precision", "recall"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return df.groupBy(*(by or ["stage"])).agg(*aggs)


def fold_metrics(df: DataFrame) -> DataFrame:
    return df.groupBy("fold", "stage").agg(
        *[weighted_mean(F.col(c), F.col("weight")).alias(c) for c in ("iou", "f1", "precision", "recall")],
        F.sum("weight").alias("weight"))


def best_fold(folds: DataFrame, stage: str = "champion_shadow") -> DataFrame:
    """First fold with the highest IoU of the stage; no rows is an error when the result is read."""
    rows = folds.filter(F.col("stage") == stage)
    best = rows.agg(F.min(F.struct((-F.round(F.col("iou"), 12)).alias("n"), F.col("fold"), F.col("iou"), F.col("weight"))).alias("b"))
    b = F.when(F.col("b").isNull(), F.raise_error(F.lit("no fold has metrics"))).otherwise(F.col("b"))
    return best.select(b["fold"].alias("fold"), b["iou"].alias("iou"), b["weight"].alias("weight"))


def score_hist(df: DataFrame, score: str, inside: str, bins: int = 40) -> DataFrame:
    """Equal-width histogram of scores inside and outside the buffer, each over its own range, last bin closed."""
    span = df.groupBy(inside).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    v = F.col(score)
    flat = F.col("_hi") == F.col("_lo")
    lo = F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo"))
    hi = F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi"))
    # the range table has at most two rows (inside, outside)
    placed = df.join(F.broadcast(span), inside)
    bin_of = F.least(F.lit(bins - 1), F.floor((v - lo) * float(bins) / (hi - lo))).cast("int")
    counts = placed.groupBy(inside, bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = span.select(inside, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, [inside, "bin"], "left").fillna(0, ["n"])

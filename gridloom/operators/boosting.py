"""Boosted trees on patch vectors with pyspark.ml, model searches, and patch scores on the cell grid."""

from __future__ import annotations

import math
from itertools import product

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from .metrics import first_best, sweep
from .tiling import PATCH, TILE, WINDOW

# fixed values: parameter names of the boosted-tree library this mirrors, and their counterparts here
PARAMS = {"max_depth": "maxDepth", "eta": "stepSize", "subsample": "subsamplingRate", "min_child_weight": "minInstancesPerNode"}
# fixed values: known names without a counterpart; they change nothing
UNSUPPORTED = {"objective", "eval_metric", "tree_method", "device", "verbosity", "seed", "nthread", "reg_alpha", "reg_lambda", "alpha", "lambda", "gamma"}


def as_ml(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col("vec").cast("array<double>")))


def classifier(params: dict, rounds: int, seed: int = 42, validation: str | None = None) -> GBTClassifier:
    """Estimator for log-loss boosting; `colsample_bytree` becomes the feature subset; an unknown name is an error."""
    if unknown := set(params) - set(PARAMS) - UNSUPPORTED - {"colsample_bytree"}:
        raise ValueError(f"unknown tree parameters: {sorted(unknown)}")
    est = GBTClassifier(labelCol="y", featuresCol="features", maxIter=rounds, seed=seed, cacheNodeIds=False)
    for name, value in params.items():
        if name in PARAMS:
            est = est.setParams(**{PARAMS[name]: value})
        elif name == "colsample_bytree":
            est = est.setParams(featureSubsetStrategy=str(float(value)) if value < 1 else "all")
    return est.setParams(validationIndicatorCol=validation) if validation else est


def train(rows: DataFrame, params: dict | None = None, rounds: int = 20, seed: int = 42) -> GBTClassificationModel:
    """Fit on rows (vec, y)."""
    return classifier(params or {}, rounds, seed).fit(as_ml(rows))


def score_patches(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    """Probability of the positive class per row, one plan for every tile."""
    out = model.transform(as_ml(rows))
    return out.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def grid(values: dict[str, list]) -> list[dict]:
    """Parameter sets in nested order."""
    return [dict(zip(values, combo)) for combo in product(*values.values())]


def split_rows(rows: DataFrame, val_fraction: float, seed: int, key: list[str]) -> DataFrame:
    """Seeded split by hash order: max(1, int(n (1 - f))) rows train, the rest validate (column `is_val`)."""
    from ..plans.ordering import ordinal

    n = rows.count()
    n_train = max(1, int(n * (1.0 - val_fraction)))
    hashed = rows.withColumn("_h", F.xxhash64(*key, F.lit(seed)))
    placed = ordinal(hashed, [F.col("_h"), *[F.col(c) for c in key]], "_i").drop("_h")
    return placed.withColumn("is_val", F.col("_i") > n_train).drop("_i")


def log_loss(y: Column, p: Column) -> Column:
    q = scores.clip01(p, 1e-15)
    return F.avg(-(y * F.ln(q) + (1.0 - y) * F.ln(1.0 - q)))


def search_logloss(rows: DataFrame, params: list[dict], rounds: int, val_fraction: float, seed: int, key: list[str]):
    """Fit each parameter set with tolerance-based early stopping; the first lowest validation log-loss wins.

    Returns (model, parameters, losses). Each fit is a distributed job; only its loss returns to the driver.
    """
    marked = as_ml(split_rows(rows, val_fraction, seed, key)).persist()
    best, losses = None, []
    for p in params:
        model = classifier(p, rounds, seed, "is_val").fit(marked)
        proba = vector_to_array("probability")[1]
        loss = model.transform(marked.filter("is_val")).agg(log_loss(F.col("y"), proba)).first()[0]
        losses.append(loss)
        if loss is not None and (best is None or loss < best[2]):
            best = (model, p, loss)
    marked.unpersist()
    if best is None:
        raise ValueError("no validation rows")
    return best[0], best[1], losses


def search_iou(rows: DataFrame, image: DataFrame, params: list[dict], thresholds: list[float], rounds: int, val_fraction: float,
               seed: int, key: list[str]):
    """Same fits, chosen by the best IoU over thresholds on a scored image (rows vec, gt); the first best stays."""
    marked = as_ml(split_rows(rows, val_fraction, seed, key)).persist()
    best = None
    for p in params:
        model = classifier(p, rounds, seed, "is_val").fit(marked)
        swept = sweep(score_patches(model, image), F.col("score"), thresholds, [])
        row = first_best(swept, "iou", ["thr_idx"]).first()
        if row is not None and (best is None or row["iou"] > best[2]["iou"]):
            best = (model, p, row)
    marked.unpersist()
    if best is None:
        raise ValueError("no scored rows")
    return best


def upsample_bilinear(patch_scores: DataFrame, windows: DataFrame, ps: int, score: str = "score", keys: list[str] = TILE) -> DataFrame:
    """Patch grid to cell grid with half-cell centres, mirrored edges and linear weights.

    The four patches around a block of cells are brought together on the patch grid; cells are then generated and
    interpolated in place, so only patch rows are shuffled. `windows` has h_eff and w_eff.
    """
    win = [*keys, *WINDOW]
    shape = windows.select(*win, F.col("h_eff").alias("_h"), F.col("w_eff").alias("_w"),
                           F.expr(f"cast(h_eff div {ps} as int)").alias("_hp"), F.expr(f"cast(w_eff div {ps} as int)").alias("_wp"))

    def roles(p: str, n: str) -> Column:
        """Blocks (index of the lower patch) a patch belongs to, as lower (0) or upper (1) neighbour."""
        at, size = F.col(p), F.col(n)
        return F.filter(F.array(
            F.struct(at.alias("q"), F.lit(0).alias("side")), F.struct((at - 1).alias("q"), F.lit(1).alias("side")),
            F.when(at == scores.mirror(F.lit(-1), size), F.struct(F.lit(-1).alias("q"), F.lit(0).alias("side"))),
            F.when(at == scores.mirror(size, size), F.struct((size - 1).alias("q"), F.lit(1).alias("side")))), lambda r: r.isNotNull())

    spread = (patch_scores.select(*win, *PATCH, F.col(score).alias("_s")).join(shape, win)
              .withColumn("_ry", F.explode(roles("py", "_hp"))).withColumn("_rx", F.explode(roles("px", "_wp"))))
    corner = {f"_s{a}{b}": F.max(F.when((F.col("_ry.side") == a) & (F.col("_rx.side") == b), F.col("_s"))) for a in (0, 1) for b in (0, 1)}
    blocks = spread.groupBy(*win, "_h", "_w", "_hp", "_wp", F.col("_ry.q").alias("_qy"), F.col("_rx.q").alias("_qx")).agg(
        *[v.alias(k) for k, v in corner.items()])

    def first_cell(q: str, size: str, n: str, shift: int) -> Column:
        """Smallest offset whose position on the patch grid is not below q + shift."""
        return F.expr(f"-floor(-(((2 * ({q} + {shift}) + 1) * {size} - {n}) / (2 * {n})))").cast("int")

    def offsets(q: str, size: str, n: str) -> Column:
        lo, hi = F.greatest(first_cell(q, size, n, 0), F.lit(0)), F.least(first_cell(q, size, n, 1) - 1, F.col(size) - 1)
        return F.when(lo <= hi, F.sequence(lo, hi))

    def fraction(i: str, q: str, size: str, n: str) -> Column:
        return ((2 * F.col(i) + 1) * F.col(n) - (2 * F.col(q) + 1) * F.col(size)) / (2.0 * F.col(size))

    cells = blocks.withColumn("_i", F.explode(offsets("_qy", "_h", "_hp"))).withColumn("_j", F.explode(offsets("_qx", "_w", "_wp")))
    ty, tx = fraction("_i", "_qy", "_h", "_hp"), fraction("_j", "_qx", "_w", "_wp")
    value = ((F.col("_s00") * (1.0 - tx) + F.col("_s01") * tx) * (1.0 - ty) + (F.col("_s10") * (1.0 - tx) + F.col("_s11") * tx) * ty)
    return cells.select(*win, (F.col("win_y") + F.col("_i")).cast("int").alias("y"), (F.col("win_x") + F.col("_j")).cast("int").alias("x"), value.alias(score))


def blend_windows(df: DataFrame, dense: DataFrame, score: str = "score", keys: list[str] = TILE) -> DataFrame:
    """Mean over the windows that scored a cell; cells without one are 0."""
    cell = [*keys, "y", "x"]
    mean = df.groupBy(*cell).agg(F.avg(score).alias(score))
    return dense.select(*cell).join(mean, cell, "left").fillna(0.0, [score])


def importance_topk(gains: DataFrame, prefix: str, k: int) -> DataFrame:
    """Top features by gain of one name prefix, with the cumulative share in ascending order of the kept rows."""
    top = gains.filter(F.col("feature").startswith(prefix)).orderBy(F.desc("gain"), "feature").limit(max(1, k))
    w = Window.orderBy("gain", F.desc("feature"))  # k rows at most
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.greatest(F.sum("gain").over(every), F.lit(1e-8))
    return top.select("feature", "gain", (F.sum("gain").over(w.rowsBetween(Window.unboundedPreceding, 0)) / total).alias("cum_share"))


def score_guard(a: DataFrame, b: DataFrame, threshold: float, atol: float = 1e-5, rtol: float = 1e-4, keys: list[str] = TILE) -> DataFrame:
    """Agreement of two score maps per tile: mean and largest difference, same mask, all close, and the mismatch flag."""
    cell = [*keys, "y", "x"]
    both = a.select(*cell, F.col("score").alias("_a")).join(b.select(*cell, F.col("score").alias("_b")), cell, "full")
    x, y = F.col("_a"), F.col("_b")
    one_sided = x.isNull() | y.isNull()
    d = F.abs(x - y)
    out = both.groupBy(*keys).agg(
        F.avg(d).alias("mean_abs_diff"), F.max(d).alias("max_abs_diff"),
        F.bool_and(F.coalesce((x >= threshold) == (y >= threshold), F.lit(False))).alias("same_mask"),
        F.bool_and(F.when(one_sided, False).otherwise(d <= F.lit(atol) + F.lit(rtol) * F.abs(y))).alias("all_close"))
    return out.withColumn("mismatch", ~(F.col("same_mask") & F.col("all_close")))


def prior_loss(p: float) -> float:
    """Log-loss of always predicting the positive share p (the bar a useful model must beat)."""
    return -(p * math.log(p) + (1 - p) * math.log(1 - p)) if 0 < p < 1 else 0.0

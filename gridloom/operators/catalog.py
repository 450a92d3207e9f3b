"""Catalog rules: which tiles to process, splits, folds, batches and progress.

Positions in a sorted list come from `plans.ordering`, so no task sorts a whole catalog.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import ordinal
from ..plans.scratch import cut
from .spatial import bbox_join, spatial_join, tile_boxes
from .tiling import TILE


def tiles_with_label(tiles: DataFrame, labels: DataFrame | None, grid: dict | None = None, nodata: int | None = None,
                     keys: list[str] = TILE) -> DataFrame:
    """Catalog with `keep`: the tile overlaps the label grid and holds a valid positive label cell.

    `labels` has src_row, src_col, v on the grid {left, top, px, height, width}. Label cells are mapped to
    tiles by bucketed equi-join. Without a label raster every tile is kept.
    """
    if labels is None:
        return tiles.withColumn("keep", F.lit(True))
    right, bottom = grid["left"] + grid["width"] * grid["px"], grid["top"] - grid["height"] * grid["px"]
    boxes = tile_boxes(tiles).filter(
        (F.col("min_x") < right) & (F.col("max_x") > grid["left"]) & (F.col("min_y") < grid["top"]) & (F.col("max_y") > bottom))
    positive = (F.col("v") > 0) if nodata is None else (F.col("v") > 0) & (F.col("v") != nodata)
    cx = F.lit(float(grid["left"])) + (F.col("src_col") + 0.5) * F.lit(float(grid["px"]))
    cy = F.lit(float(grid["top"])) - (F.col("src_row") + 0.5) * F.lit(float(grid["px"]))
    block = float(grid["px"]) * 64
    # cells keep their exact place; buckets only route them to the tiles of the same block
    pts = labels.filter(positive).select(cx.alias("cx"), cy.alias("cy"), F.floor(cx / block).alias("_bx"), F.floor(cy / block).alias("_by"))
    near = (boxes.withColumn("_bx", F.explode(F.sequence(F.floor(F.col("min_x") / block), F.floor(F.col("max_x") / block))))
            .withColumn("_by", F.explode(F.sequence(F.floor(F.col("min_y") / block), F.floor(F.col("max_y") / block)))))
    hit = near.join(pts, [near["_bx"] == pts["_bx"], near["_by"] == pts["_by"], F.col("cx") >= F.col("min_x"), F.col("cx") < F.col("max_x"),
                          F.col("cy") > F.col("min_y"), F.col("cy") <= F.col("max_y")], "left_semi").select(*keys).distinct()
    return (tiles.join(hit.withColumn("keep", F.lit(True)), keys, "left").fillna(False, ["keep"]))


def with_cached_decisions(tiles: DataFrame, cache: DataFrame, decide, raster_sig: str) -> DataFrame:
    """Reuse decisions whose tile and raster signatures are unchanged, decide only the others.

    `tiles` has path, mtime, size; `cache` the same plus raster_sig and keep; `decide` maps the missing tiles to tiles with `keep`.
    """
    sig = ["path", "mtime", "size", "raster_sig"]
    signed = tiles.withColumn("raster_sig", F.lit(raster_sig))
    known = signed.join(cache.select(*sig, "keep"), sig).withColumn("cached", F.lit(True))
    fresh = decide(signed.join(cache.select(*sig), sig, "left_anti")).withColumn("cached", F.lit(False))
    return known.unionByName(fresh.select(*known.columns))


def tiles_touching(tiles: DataFrame, geoms: DataFrame, bucket: float, exact: bool = True, keys: list[str] = TILE) -> DataFrame:
    """Tiles whose box meets any geometry."""
    from .spatial import with_bbox

    pairs = spatial_join(geoms, tiles, bucket) if exact else bbox_join(with_bbox(geoms), tile_boxes(tiles), bucket)
    return tiles.join(pairs.select(*keys).distinct(), keys, "left_semi")


def effective_gt(tiles: DataFrame, gt: DataFrame, buffer: DataFrame | None, keys: list[str] = TILE) -> DataFrame:
    """Ground-truth cells per tile after the optional clip; tiles without any get 0."""
    cell = [*keys, "y", "x"]
    used = gt.select(*cell) if buffer is None else gt.select(*cell).join(buffer.select(*cell), cell, "left_semi")
    n = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("gt_cells"))
    return tiles.select(*keys).join(n, keys, "left").fillna(0, ["gt_cells"])


def split_gt_tiles(tiles: DataFrame, kept: DataFrame, touching: DataFrame, effective: DataFrame, keys: list[str] = TILE) -> DataFrame:
    """Two-pass split of the kept tiles: touching and non-empty ground truth trains, the rest is inferred."""
    return (
        tiles.join(kept.filter("keep").select(*keys), keys, "left_semi")
        .join(touching.select(*keys, F.lit(True).alias("_t")), keys, "left").join(effective, keys, "left")
        .withColumn("split", F.when(F.coalesce("_t", F.lit(False)) & (F.col("gt_cells") > 0), "train").otherwise("inference"))
        .drop("_t"))


def seeded_order(df: DataFrame, path: str, seed: int, name: str) -> DataFrame:
    """Positions from 1 in the order of a seeded digest, which any engine can repeat."""
    return ordinal(df.withColumn("_h", F.md5(F.concat_ws("|", path, F.lit(str(seed))))), [F.col("_h"), F.col(path)], name).drop("_h")


def train_val_split(tiles: DataFrame, fraction: float, seed: int, path: str = "path") -> DataFrame:
    """Seeded split: val = max(1, round-half-even(n f)), below n; one tile serves as both. Rows (path, role)."""
    n = tiles.count()
    if n == 0:
        raise ValueError("no ground-truth tile")
    if n == 1:
        return tiles.select(path, F.explode(F.array(F.lit("train"), F.lit("val"))).alias("role"))
    n_val = min(max(1, int(round(n * fraction))), n - 1)
    placed = seeded_order(tiles.select(path), path, seed, "_i")
    return placed.select(path, F.when(F.col("_i") <= n_val, "val").otherwise("train").alias("role"))


def pending_tiles(tiles: DataFrame, done: DataFrame, path: str = "path") -> DataFrame:
    """Tiles not done yet with their 1-based index and the total, in path order."""
    rest = tiles.join(done.select(F.col("tile_path").alias(path)).distinct(), path, "left_anti")
    placed = cut(ordinal(rest, [F.col(path)], "idx"), "pending")
    total = placed.agg(F.count(F.lit(1)).alias("total"))
    return placed.join(F.broadcast(total))  # one row


def every_nth(df: DataFrame, n: int, idx: str = "idx") -> DataFrame:
    return df.withColumn("flag", F.pmod(F.col(idx) - 1, F.lit(max(1, n))) == 0)


def round_robin(tiles: DataFrame, k: int, path: str = "path") -> DataFrame:
    return ordinal(tiles, [F.col(path)], "_i").withColumn("shard", F.pmod(F.col("_i") - 1, F.lit(k))).drop("_i")


def contiguous_batches(tiles: DataFrame, size: int, path: str = "path") -> DataFrame:
    return ordinal(tiles, [F.col(path)], "_i").withColumn("batch", F.expr(f"(_i - 1) div {size}")).drop("_i")


def shard_manifest(assigned: DataFrame, k: int, by: str = "shard") -> DataFrame:
    """Tiles per shard, empty shards included."""
    n = assigned.groupBy(by).agg(F.count(F.lit(1)).alias("n_tiles"))
    return assigned.sparkSession.range(k).select(F.col("id").alias(by)).join(n, by, "left").fillna(0, ["n_tiles"])


def batch_progress(batches: DataFrame, done: DataFrame, retries: DataFrame, max_retries: int) -> DataFrame:
    """Distinct done tiles against expected ones per batch, completeness and whether a retry is allowed."""
    seen = done.filter("status = 'done'").select("batch", "tile_path").distinct().groupBy("batch").agg(F.count(F.lit(1)).alias("done_tiles"))
    want = batches.groupBy("batch").agg(F.count(F.lit(1)).alias("expected_tiles"))
    out = want.join(seen, "batch", "left").join(retries, "batch", "left").fillna(0, ["done_tiles", "retry_count"])
    out = out.withColumn("complete", F.col("done_tiles") >= F.col("expected_tiles"))
    return out.withColumn("retryable", ~F.col("complete") & (F.col("retry_count") < max_retries))


def ready_to_merge(progress: DataFrame) -> DataFrame:
    return progress.agg(F.coalesce(F.bool_and("complete"), F.lit(False)).alias("ready"))


def loo_folds(tiles: DataFrame, v: int, path: str = "path") -> DataFrame:
    """Cyclic folds as position ranges (fold, role, from_idx, to_idx), both ends included.

    Fold i validates positions i..i+v-1 modulo n and trains on the rest. Ranges keep the table linear in n, where
    listing the training tiles of every fold would be quadratic. `fold_tiles` lists the validation tiles.
    """
    n = tiles.count()
    if n and v >= n:
        raise ValueError("validation tiles per fold must be fewer than tiles")
    f = tiles.sparkSession.range(n).withColumnRenamed("id", "fold")
    end = F.col("fold") + v - 1
    wraps = end >= n

    def piece(role: str, lo: Column, hi: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), lo.cast("bigint").alias("from_idx"), hi.cast("bigint").alias("to_idx"))

    last = F.lit(n - 1)
    rows = F.array(
        piece("val", F.col("fold"), F.least(end, last)), piece("val", F.lit(0), F.when(wraps, end - n)),
        piece("train", F.when(wraps, end - n + 1).otherwise(F.lit(0)), F.col("fold") - 1), piece("train", F.when(~wraps, end + 1), last))
    return f.select("fold", F.explode(rows).alias("_p")).select("fold", "_p.*").filter("from_idx <= to_idx")


def fold_tiles(tiles: DataFrame, v: int, path: str = "path") -> DataFrame:
    """Validation tiles of every fold: v rows per tile."""
    n = tiles.count()
    placed = ordinal(tiles.select(path), [F.col(path)], "idx", start=0)
    back = F.explode(F.sequence(F.lit(0), F.lit(v - 1)))
    return placed.withColumn("_b", back).select(F.pmod(F.col("idx") - F.col("_b"), F.lit(n)).alias("fold"), path, "idx")


def apply_low_gt(val_tiles: DataFrame, gt: DataFrame, min_cells: int, policy: str, n_tiles: int, v: int, path: str = "path") -> DataFrame:
    """Ground truth over each fold's validation tiles, skip reason under the policy, and whether training reuses a tile."""
    sums = val_tiles.join(gt.select(path, "gt_cells"), path).groupBy("fold").agg(F.sum("gt_cells").alias("gt_cells"))
    low = F.col("gt_cells") < min_cells if policy == "skip_fold" else F.lit(False)
    return sums.withColumn("reason", F.when(low, "low_gt")).withColumn("reuse_val", F.lit(n_tiles - v <= 0))

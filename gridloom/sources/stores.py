"""Keyed Parquet stores and sinks: mosaics, features, banks, polygons, summaries, model bundles."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tiling import WINDOW
from . import versions

MOSAIC_SCHEMA = "gy int, gx int, v int, variant string, block_y int, block_x int"
BLOCK = 512


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# ---- mosaics --------------------------------------------------------------------------------------------------

def with_block(df: DataFrame, block: int = BLOCK) -> DataFrame:
    return df.withColumn("block_y", F.expr(f"cast(floor(gy / {block}) as int)")).withColumn("block_x", F.expr(f"cast(floor(gx / {block}) as int)"))


def read_mosaic(spark: SparkSession, path: str) -> DataFrame:
    """Mosaic cells; a missing mosaic is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], MOSAIC_SCHEMA)
    return spark.read.schema(MOSAIC_SCHEMA).parquet(path)


def union_masks(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("variant", "gy", "gx", "v").unionByName(b.select("variant", "gy", "gx", "v")).groupBy("variant", "gy", "gx").agg(F.max("v").alias("v"))


def append_union(new: DataFrame, path: str, block: int = BLOCK) -> None:
    """OR new cells (variant, gy, gx, v) into the mosaic, rewriting only the touched (variant, block) folders.

    The union is written to a scratch table before the folders are replaced, since a job must not overwrite what it reads.
    Repeating a call changes nothing.
    """
    from ..plans.scratch import StepTable

    spark = new.sparkSession
    fresh = StepTable(with_block(new, block), "mosaic-new")
    part = ["variant", "block_y", "block_x"]
    touched = fresh.df.select(*part).distinct()
    old = read_mosaic(spark, path).join(touched, part, "left_semi")
    merged = StepTable(with_block(union_masks(old, fresh.df), block), "mosaic")
    # a block holds at most 512 x 512 cells
    (merged.df.repartition(*part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*part).parquet(path))
    fresh.drop()
    merged.drop()


def check_tile_shape(mask: DataFrame, tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Mask rows; a cell outside its tile is an error."""
    bad = (F.col("y") < 0) | (F.col("x") < 0) | (F.col("y") >= F.col("height")) | (F.col("x") >= F.col("width"))
    shaped = mask.join(tiles.select(*keys, "height", "width"), keys)
    return shaped.withColumn("y", F.when(bad, F.raise_error(F.lit("mask does not fit its tile")).cast("int")).otherwise(F.col("y"))).drop("height", "width")


def backup_union(path: str, backup: str, step: int, every: int, spark: SparkSession, numbered: bool = False) -> str | None:
    """Copy the mosaic every `every` steps, to one rotating folder or to a numbered one; returns the folder written."""
    if every <= 0 or step % every:
        return None
    target = f"{backup}/step_{step:06d}" if numbered else f"{backup}/latest"
    read_mosaic(spark, path).write.mode("overwrite").partitionBy("variant", "block_y", "block_x").parquet(target)
    return target


# ---- features -------------------------------------------------------------------------------------------------

FEATURE_KEY = ["spec_hash", "ps", "resample", "image_id", *WINDOW]


def write_features(df: DataFrame, path: str, spec_hash: str, ps: int, resample: int, removed: DataFrame | None = None) -> None:
    """Store windows of a spec as a new version; they replace what is stored of the same windows. `removed` (image_id and window columns) are deleted."""
    spec = lambda rows: rows.withColumn("spec_hash", F.lit(spec_hash)).withColumn("ps", F.lit(ps)).withColumn("resample", F.lit(resample))
    versions.append(spec(df), path, None if removed is None else spec(removed), FEATURE_KEY)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return versions.read(spark, path, FEATURE_KEY)


def valid_features(store: DataFrame, spec_hash: str, ps: int, resample: int, expected: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Stored rows of the current spec; with `expected` window shapes (hp, wp) windows of another shape are dropped."""
    keys = keys or ["image_id"]
    rows = store.filter((F.col("spec_hash") == spec_hash) & (F.col("ps") == ps) & (F.col("resample") == resample))
    if expected is None:
        return rows
    win = [*keys, *WINDOW]
    shape = rows.groupBy(*win).agg((F.max("py") + 1).alias("hp"), (F.max("px") + 1).alias("wp"))
    good = shape.join(expected.select(*win, "hp", "wp"), [*win, "hp", "wp"], "left_semi")
    return rows.join(good.select(*win), win, "left_semi")


def feature_manifest(store: DataFrame, ps: int, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["image_id"]
    return store.groupBy(*keys, *WINDOW).agg((F.max("py") + 1).alias("hp"), (F.max("px") + 1).alias("wp")).select(
        *keys, *WINDOW, "hp", "wp", (F.col("hp") * ps).alias("h_eff"), (F.col("wp") * ps).alias("w_eff"))


def consolidate(store: DataFrame, image: str = "image_id") -> DataFrame:
    """Rows of every image numbered in the order of window file names (text order) and then patch position."""
    from ..plans.ordering import group_ordinal

    name = F.concat(F.col(image).cast("string"), F.lit("_y"), F.col("win_y"), F.lit("_x"), F.col("win_x"))
    return group_ordinal(store.withColumn("file", name), [image], [F.col("file"), F.col("py"), F.col("px")], "n")


# ---- banks ----------------------------------------------------------------------------------------------------

# fixed values: what a stored bank depends on
BANK_KEY = ["image_id", "ps", "context", "resample", "spec_hash"]


def write_bank(df: DataFrame, path: str) -> None:
    """Store the banks of the images in `df` (BANK_KEY, vector columns) as a new version; stale banks of the same images go, other images stay."""
    versions.append(df, path)


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    return versions.read(spark, path, ["image_id"])


def prune_banks(store: DataFrame, current: dict) -> DataFrame:
    """Bank rows whose key equals the current one; stale keys are left out."""
    out = store
    for name, value in current.items():
        out = out.filter(F.col(name) == value)
    return out


# ---- polygons and summaries -----------------------------------------------------------------------------------

def append_polygons(df: DataFrame, path: str, start_id: int, order: list[Column]) -> int:
    """Append numbered polygons; returns the next free id. A repeated call with the same start replaces what it wrote before."""
    from ..operators.polygons import append_ids

    numbered, next_id = append_ids(df, start_id, order)
    if next_id > start_id:
        numbered.write.mode("overwrite").parquet(f"{path}/start_id={start_id}")
    return next_id


def count_features(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).count() if exists(spark, path) else 0


def write_summary(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


# ---- model bundles --------------------------------------------------------------------------------------------

def save_bundle(model: PipelineModel, settings: dict, path: str, spark: SparkSession) -> None:
    model.write().overwrite().save(f"{path}/model")
    manifest = {"model": "model", "settings": settings}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_bundle(path: str, spark: SparkSession) -> tuple[PipelineModel, dict]:
    """Model and settings; a missing manifest or model entry is an error."""
    if not exists(spark, f"{path}/manifest"):
        raise FileNotFoundError(f"no manifest in {path}")
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if not manifest.get("model"):
        raise ValueError("manifest names no model")
    return PipelineModel.load(f"{path}/{manifest['model']}"), manifest["settings"]

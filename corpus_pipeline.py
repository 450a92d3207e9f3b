"""A corpus pipeline: low quality and toxic documents go, one of each group of near duplicates stays, secrets are masked, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `docs`. `run` writes each result as Parquet to the
shared folder and reads it again, so a stage starts from files, survives lost executors, and never repeats an earlier one.

Rows with a null text have no reason to go before packing; a null doc_id takes part in every stage but is never a duplicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import importance, ngram_join, packing, secret_scan, token_ids, toxicity
from gridloom.plans.scratch import cut, new_path


def _same_columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling: documents below the key of the k-th draw go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    _, ratios, least = importance.select(docs, labels)
    return _same_columns(importance.weigh(docs, ratios, prefix="__").filter(F.col("__gumbel_key") >= F.lit(least)), docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or of sentence scores reaches toxicity.TOXIC_FROM go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _same_columns(toxicity.score(docs, model, prefix="__").filter(F.col("__score") < toxicity.TOXIC_FROM), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays; of rows that repeat an id, one."""
    found = cut(ngram_join.near_duplicates(docs), "groups")
    gone = cut(found.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")  # by its measured size the ids go to the texts, not the texts through a shuffle
    kept = docs.join(gone, "doc_id", "left_anti")
    repeated = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if not repeated.isEmpty():
        first = Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
        one = kept.join(repeated, "doc_id", "left_semi").withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__r")
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(one)
    return _same_columns(kept, docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is masked; n_chars follows the text."""
    out = secret_scan.redact(docs, secret_scan.train(docs))
    return _same_columns(out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their ids."""
    return packing.packed(docs, token_ids.path(token_ids.WORD_BPE), 1)


STAGES = [("quality", quality), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", pack)]

#: SQL cannot express the stages' models and hashes; tests/llm hold the result against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

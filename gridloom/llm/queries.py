"""Registered queries of the subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import new_path
from . import chat_format, importance, katz, lexicon, metric_join, ngram_join, packing, plane_files, quality_rules, repair, secret_scan, sql, token_ids, toxicity, vector_codes
from .common import fold, lean, table


def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), fold("doc_id", 5) == 1, katz.KATZ)


def op2_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.packed(docs, token_ids.path(token_ids.WORD_BPE), 1, with_ids=False)


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, log_ratio, gumbel_key, kept."""
    weighed, _, least = importance.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return weighed.withColumn("kept", F.col("gumbel_key") >= F.lit(least))


def op4_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold("doc_id", 4) == 2
    model = toxicity.train(docs, labels.filter(~held))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC_FROM).cast("int").alias("predicted"), "offending")


def op5_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "planes")
    plane_files.write(table(spark, sf_dir, "documents"), folder, token_ids.path(token_ids.BYTE_BPE), 0)
    return plane_files.read(spark, folder)


def op6_prefix_orders_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.report(docs, secret_scan.train(docs))


def op8_pivot_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, file = table(spark, sf_dir, "documents"), token_ids.path(token_ids.BYTE_BPE)
    return lexicon.encoded(docs.select("doc_id", "text"), file, lexicon.build(docs, file), with_ids=False).drop("text")


def op10_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality_rules.judge(docs.select("doc_id", "text", "lang"), quality_rules.references(docs))
    return judged.drop("text", "lang")


def op11_chat_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted conversations go to files; what is returned is read back from them."""
    told = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], rows.schema)
    folder = new_path(spark, "chat")
    with lean(spark):
        chat_format.formatted(rows.unionByName(extra)).write.parquet(folder)
    return chat_format.digests(spark.read.parquet(folder))


def op12_astar_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(repair.damaged(repair.source(table(spark, sf_dir, "conversations"))))


def op13_limb_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_katz_backoff, op2_cost_balanced_packing, op3_importance_resampling, op4_noisy_or_toxicity, op5_plane_files, op6_prefix_orders_join, op7_markov_secrets, op8_pivot_range_join,
                                  op9_transducer_bpe, op10_divergence_rules, op11_chat_templates, op12_astar_repair, op13_limb_codes)}
SQL: dict[str, str] = {"op6_prefix_orders_join": sql.NGRAM_JOIN, "op8_pivot_range_join": sql.RANGE_JOIN, "op11_chat_templates": sql.CHAT, "op12_astar_repair": sql.REPAIR, "op13_limb_codes": sql.CODES}

"""Quality by importance resampling with hashed n-grams.

Two bags of hashed word unigrams and bigrams are counted: the target (all labelled good documents) and the raw text (all documents).
A document's log importance weight is the sum over its n-grams of log target share - log raw share. Adding independent Gumbel noise to the log
weights and taking the k largest draws k documents without replacement in proportion to their weights.

The noise is a function of the seed and the document id, so a run can be repeated. `k` is given, or is the number of documents at or above the key that
separates all labelled good and bad documents best, from running totals over key ranges; the k-th largest key itself is found by counting, never by sorting all rows in one task.

Defined cases: a null or empty text has weight 0; rows tied with the k-th key are all kept, so repeated rows share a fate; without labels, or with labels
of one class only, every document is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import running_total
from ..plans.scratch import cut
from .common import U64, batch_of, give_back, looked_up, mix, slices, texts, with_columns, word_hashes


@dataclass(frozen=True)
class Settings:
    """`bits`: log2 of the n-gram buckets; `ids_at_once`: labelled ids that go to the texts in one pass, more of them in more passes."""

    bits: int = 14
    smoothing: float = 1.0
    ids_at_once: int = 500_000
    seed: int = 7


def _buckets(bodies: list[bytes], memo, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram, and the document it belongs to."""
    split = [t.lower().split() for t in bodies]
    memo.trim()
    ids = looked_up(memo, [w for ws in split for w in ws], U64)
    doc = np.repeat(np.arange(len(split)), [len(w) for w in split])
    pair = doc[1:] == doc[:-1]
    two = mix(ids[:-1] * U64(0x9E3779B97F4A7C15) + ids[1:])[pair]
    mask = U64((1 << bits) - 1)
    return (np.concatenate([mix(ids) & mask, two & mask]).astype(np.int64), np.concatenate([doc, doc[1:][pair]]))


def log_ratios(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text", label: str = "quality") -> np.ndarray:
    """Log of target share over raw share for each bucket; 2^bits numbers."""
    good = cut(labels.filter(F.col(label) == 1).select(F.col(key).alias("__k")).distinct(), "good").withColumn("__good", F.lit(True))
    bits = s.bits

    def count(batches):
        schema = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])
        memo, total = word_hashes(), np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for part in slices(batch):
                good = np.array(part.column("good").to_pylist(), bool)
                bucket, doc = _buckets(texts(part.column("text")), memo, bits)
                total[0] += np.bincount(bucket, minlength=1 << bits)
                total[1] += np.bincount(bucket[good[doc]], minlength=1 << bits)
        yield batch_of(schema, np.arange(1 << bits), total[0], total[1])
        give_back()

    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    passes = max(1, -(-good.count() // s.ids_at_once))
    for k in range(passes):
        # ids go to the texts, so that no text is shuffled; the first pass counts all texts, the others those of their own ids
        some = F.broadcast(good.filter(F.pmod(F.xxhash64("__k"), F.lit(passes)) == k))
        rows = (docs.select(F.col(key).alias("__k"), F.col(text).alias("text")).join(some, "__k", "inner" if k else "left")
                .select(F.coalesce("__good", F.lit(False)).alias("good"), "text"))
        counted = rows.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        for r in counted.collect():  # 2^bits rows
            raw[r["bucket"]] += 0 if k else r["raw"]
            target[r["bucket"]] += r["target"]
    if not target.sum():
        return np.zeros(1 << bits)
    share = [(c + s.smoothing) / (c.sum() + s.smoothing * len(c)) for c in (target, raw)]
    return np.log(share[0]) - np.log(share[1])


def weigh(docs: DataFrame, ratios: np.ndarray, s: Settings = Settings(), key: str = "doc_id", text: str = "text", prefix: str = "") -> DataFrame:
    """`docs` with `log_ratio` and `gumbel_key` (the log ratio plus Gumbel noise); `prefix` stands before the new names."""
    table = docs.sparkSession.sparkContext.broadcast(ratios)  # 2^bits numbers, a parameter
    bits, seed = s.bits, s.seed

    def values(part: pa.RecordBatch) -> list:
        bucket, doc = _buckets(texts(part.column("text")), word_hashes(), bits)
        weight = np.bincount(doc, table.value[bucket], minlength=part.num_rows)
        u = np.array([(xxhash.xxh3_64_intdigest(str(k), seed) >> 11) + 0.5 for k in part.column("key").to_pylist()]) / (1 << 53)
        return [weight, weight - np.log(-np.log(u))]

    return with_columns(docs, f"{prefix}log_ratio double, {prefix}gumbel_key double", values, ["key", "text"], [key, text])


def best_cut(weighed: DataFrame, labels: DataFrame, s: Settings = Settings(), key: str = "doc_id", label: str = "quality") -> float:
    """The key at which fewest of all labelled documents fall on the wrong side: between the last key below the cut and the next."""
    chosen = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("__k")).agg(F.max(label).alias("__y"))
    good = F.col("__y").cast("bigint")
    # good documents less bad ones, up to each key: what a cut after it has wrong beyond the bad documents
    each = (weighed.select(F.col(key).alias("__k"), "gumbel_key").join(chosen, "__k").groupBy("gumbel_key")
            .agg(F.sum(good).alias("good"), F.sum(1 - good).alias("bad")))
    below = running_total(each, [F.col("gumbel_key")], "more", F.col("good") - F.col("bad"))
    found = below.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min(F.struct("more", "gumbel_key")).alias("at")).first()
    if not found["good"] or not found["bad"] or found["at"]["more"] >= 0:
        return -np.inf
    last = found["at"]["gumbel_key"]
    after = below.filter(F.col("gumbel_key") > F.lit(last)).agg(F.min("gumbel_key")).first()[0]
    return np.inf if after is None else (last + after) / 2


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value, by counting in ever finer bins; `inf` for k < 1, `-inf` if there are no more than k rows."""
    total, low, high = df.agg(F.count(column), F.min(column), F.max(column)).first()
    if k < 1:
        return np.inf
    if total <= k:
        return -np.inf
    above = 0
    while True:
        inside = df.filter(F.col(column).between(low, high))
        width = (high - low) / bins
        if width <= 0 or low + width == low or high - width == high:  # values next to each other: count each one
            each = inside.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc(column)).collect()
            for r in each:
                above += r["n"]
                if above >= k:
                    return float(r[column])
        slot = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.lit(low)) / F.lit(width))).cast("int")
        found = inside.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for r in sorted(found, key=lambda r: -r["slot"]):
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
        if low == high:
            return float(low)


def select(docs: DataFrame, labels: DataFrame, k: int | None = None, s: Settings = Settings(), key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[DataFrame, np.ndarray, float]:
    """Weighed ids (written once), the bucket table, and the key from which on documents are kept."""
    ratios = log_ratios(docs, labels, s, key, text, label)
    weighed = cut(weigh(docs.select(key, text), ratios, s, key, text).drop(text), "importance")
    if k is None:
        least = best_cut(weighed, labels, s, key, label)
        k = weighed.filter(F.col("gumbel_key") >= least).count()
    return weighed, ratios, kth_largest(weighed, "gumbel_key", k)

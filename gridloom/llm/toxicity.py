"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is the logistic of a bias and the sum of its words' weights; a word's weight is the sum
over its hashed parts (the word and its character n-grams, as often as they occur in it). A document's score is the noisy-or of its sentences, 1 - prod(1 - s), so labels
of documents train scores of sentences, and the sentences that carry the blame are found afterwards.

The model is fitted on a bounded sample of labelled documents (`Fit.sample`): a share of toxic ones, and within a label half in proportion and half
in equal parts to languages and sources, weighted back. A part is learned if enough toxic documents have it, and clearly more often than clean ones;
both limits are counts, so a larger sample learns rarer words. Every document is scored over its whole text, in one pass without a shuffle.

Defined cases: a null or empty text has no sentence and scores 0; without labelled documents all scores are 0; rows with a null label
are not learned from; repeated rows score alike.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, batch_of, looked_up, mix, ragged, remembered, slices, starts, texts, with_columns

_EDGES = b".,;:!?\"'()*#$%&"
#: A document counts as toxic from this score on, in the query and in the pipeline.
TOXIC_FROM = 0.3
#: Words whose weights a task remembers.
MEMO_WORDS = 150_000
#: Words whose parts are hashed at once on the driver: hashing takes about a hundred times the room of the words.
HASH_WORDS = 20_000
_ENDS = bytes.maketrans(b".!?\n", b"\n\n\n\n")


@dataclass(frozen=True)
class Fit:
    """About `sample` labelled documents are learned from, `toxic` of them toxic if there are so many; `bits` is the log2 of the number of hashed parts."""

    sample: int = 6000
    toxic: float = 0.25
    bits: int = 18
    grams: tuple[int, ...] = (5, 6, 7)
    epochs: int = 130
    rate: float = 0.03
    decay: float = 2e-6
    start_bias: float = -7.0
    support: int = 5  # toxic documents that a part must occur in, or it would be learned by heart
    gain: float = 10.0  # least likelihood-ratio statistic (one degree of freedom) of a part being more frequent in toxic documents


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, 2^bits
    bias: float
    fit: Fit


def _parts(words: Sequence[bytes], fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Hashed parts of words: each word itself, and the character n-grams (of up to seven bytes) of the marked word.

    Returned are the parts and the numbers of their words. A gram is packed into 64 bits with its length, so all grams of many words are hashed at once.
    """
    mask = U64((1 << fit.bits) - 1)
    bare = [w.strip(_EDGES).lower() for w in words]
    at = np.flatnonzero(np.fromiter(map(len, bare), np.int64, len(bare)))
    whole = np.fromiter((xxhash.xxh3_64_intdigest(b"=" + bare[i]) for i in at), U64, len(at))
    size = np.fromiter((len(bare[i]) + 2 for i in at), np.int64, len(at))
    byte = np.frombuffer(b"".join(b"<" + bare[i] + b">" for i in at), np.uint8).astype(U64)
    owner = np.repeat(at, size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(byte))  # bytes from here to the end of the word
    found, owners = [whole & mask], [at]
    for n in fit.grams:
        here = np.flatnonzero(left >= n)
        gram = np.full(len(here), n << 56, U64)
        for k in range(n):
            gram |= byte[here + k] << U64(8 * k)
        found.append(mix(gram) & mask)
        owners.append(owner[here])
    return np.concatenate(found).astype(np.int32), np.concatenate(owners)


def _all_parts(words: Sequence[bytes], fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """`_parts` of many words, in order of their words and a bounded number at a time."""
    parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for i in range(0, len(words), HASH_WORDS):
        some = words[i:i + HASH_WORDS]
        part, owner = _parts(some, fit)
        parts.append(part[np.argsort(owner, kind="stable")])
        sizes.append(np.bincount(owner, minlength=len(some)))
    n = np.concatenate(sizes)
    return np.concatenate(parts), np.repeat(np.arange(len(n), dtype=np.int32), n)


def sentences(text: bytes) -> list[list[bytes]]:
    """Words of each sentence; sentences end at . ! ? and line ends."""
    return [w for s in text.translate(_ENDS).split(b"\n") if (w := s.split())]


def _noisy_or(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log of prod(1 - s) for each document, from its sentences' logits; `at` are offsets, documents may be empty."""
    quiet = -np.logaddexp(0.0, logits)
    total = np.concatenate([[0.0], np.cumsum(quiet)])
    return total[at[1:]] - total[at[:-1]]


def _level(sizes: list[int], quota: float) -> float:
    """The level q at which min(size, q) adds up to the quota."""
    for left, n in zip(range(len(sizes), 0, -1), sorted(sizes), strict=True):
        if n * left >= quota:
            return quota / left
        quota -= n
    return math.inf


def shares(sizes: dict[tuple[int, int], int], fit: Fit) -> dict[tuple[int, int], float]:
    """Share of each (label, stratum) to draw, from their sizes. No share is under half of its label's: weights stay within a factor of two."""
    of = {y: sum(n for (label, _), n in sizes.items() if label == y) for y in (0, 1)}
    toxic = max(min(of[1], fit.sample * fit.toxic), min(of[1], fit.sample - of[0]))
    out = {}
    for y, quota in ((1, toxic), (0, min(of[0], fit.sample - toxic))):
        own = {k: n for k, n in sizes.items() if k[0] == y}
        level = _level(list(own.values()), quota / 2)
        out |= {k: 1.0 if quota >= of[y] else min(1.0, quota / 2 / of[y] + min(1.0, level / n)) for k, n in own.items()}
    return out


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), key: str = "doc_id", text: str = "text", label: str = "toxic", strata: tuple[str, ...] = ("lang", "source")) -> Model:
    """Fit on about `fit.sample` documents with a label of 0 or 1; the caller leaves out what must not be learned. Columns of `strata` that `docs` lacks are ignored."""
    marks = labels.filter(F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    within = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in strata if c in docs.columns]
    # only labelled documents that exist are drawn from
    known = docs.select(key, F.pmod(F.xxhash64(*within), F.lit(256)).cast("int").alias("s") if within else F.lit(0).alias("s")).groupBy(key).agg(F.min("s").alias("s")).join(marks, key)
    share = shares({(r["y"], r["s"]): r["count"] for r in known.groupBy("y", "s").count().collect()}, fit)  # two labels by 256 strata at most
    if not share:
        return learn((), fit)
    rates = docs.sparkSession.createDataFrame([(y, s, x) for (y, s), x in share.items()], "y int, s int, share double")
    draw = F.pmod(F.xxhash64(key, F.lit("toxicity")), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    chosen = known.join(F.broadcast(rates), ["y", "s"]).filter(draw).select(key, "y", (1 / F.col("share")).alias("weight"))
    rows = docs.select(key, F.col(text).alias("text")).join(F.broadcast(chosen), key)

    def words(batches):
        schema = pa.schema([("y", pa.int32()), ("weight", pa.float64()), ("sizes", pa.binary()), ("words", pa.binary())])
        for batch in batches:
            for part in slices(batch):
                for y, weight, t in zip(part.column("y").to_pylist(), part.column("weight").to_pylist(), texts(part.column("text")), strict=True):
                    bag = sentences(t)
                    yield batch_of(schema, [y], [weight], [np.array([len(s) for s in bag], np.int32).tobytes()], [b" ".join(w for s in bag for w in s)])

    seen = rows.select("y", "weight", "text").mapInArrow(words, "y int, weight double, sizes binary, words binary").collect()  # about fit.sample rows
    return learn(((r["y"], r["weight"], np.frombuffer(r["sizes"], np.int32), bytes(r["words"]).split()) for r in seen), fit)


def _gain(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Likelihood-ratio statistic of document counts in toxic and clean documents; negative where clean ones have the part more often."""
    def likely(k, n, p):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(np.where(k > 0, p, 1)), 0) + np.where(n > k, (n - k) * np.log(np.where(n > k, 1 - p, 1)), 0)

    p, q, both = pos / max(n_pos, 1), neg / max(n_neg, 1), (pos + neg) / max(n_pos + n_neg, 1)
    out = 2 * (likely(pos, n_pos, p) + likely(neg, n_neg, q) - likely(pos, n_pos, both) - likely(neg, n_neg, both))
    return np.where(p > q, out, -out)


def learn(bags: Iterable[tuple[int, float, Sequence[int], list[bytes]]], fit: Fit) -> Model:
    """Maximum likelihood of the noisy-or by Adam; a bag is a label, its weight, the sizes of its sentences and their words one after another."""
    number: dict[bytes, int] = {}
    labels, given, counts, each, tokens = [], [], [], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for label, weight, own, words in bags:
        labels.append(label)
        given.append(weight)
        counts.append(len(own))
        each.append(np.array(own, np.int32))
        tokens.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
    if not labels:
        return Model(np.zeros(1 << fit.bits, np.float32), -np.inf, fit)
    words = len(number)
    part, part_word = _all_parts(list(number), fit)
    number.clear()
    ends = starts(np.bincount(part_word, minlength=words))
    found = np.zeros((2, 1 << fit.bits))
    for label, own in zip(labels, tokens[1:], strict=True):
        w = np.unique(own)
        found[label, np.unique(ragged(part, ends[w], ends[w + 1] - ends[w]))] += 1
    y = np.array(labels, float)
    kept = (found[1] >= fit.support) & (_gain(found[1], found[0], int(y.sum()), int((1 - y).sum())) >= fit.gain)
    # from here on only kept parts, words that have one, and their places
    live = kept[part]
    part, part_word = (np.cumsum(kept) - 1)[part[live]], part_word[live]
    has = np.bincount(part_word, minlength=words) > 0
    tokens, sizes, docs_at = np.concatenate(tokens), np.concatenate(each), starts(np.array(counts))
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[has[tokens]]
    tokens, part_word, words, width = (np.cumsum(has) - 1)[tokens[has[tokens]]], (np.cumsum(has) - 1)[part_word], int(has.sum()), int(kept.sum())
    doc_of = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(docs_at))
    by_doc = np.array(given) / sum(given)
    bias = fit.start_bias
    weights, m, v, mb, vb = np.zeros(width), np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, fit.epochs + 1):
        by_word = np.bincount(part_word, weights[part], minlength=words)
        logits = bias + np.bincount(owner, by_word[tokens], minlength=len(sizes))
        quiet = np.minimum(_noisy_or(logits, docs_at), -1e-9)
        # d loss / d logit of a sentence: its own score, times -1 for a clean document and times (1 - P) / P for a toxic one
        pull = np.where(y > 0, -np.exp(quiet) / -np.expm1(quiet), 1.0) * by_doc
        g_logit = pull[doc_of] / (1 + np.exp(-np.clip(logits, -40, 40)))
        g_word = np.bincount(tokens, g_logit[owner], minlength=words)
        g = np.bincount(part, g_word[part_word], minlength=width) + fit.decay * weights
        gb = g_logit.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, b = 1 - 0.9**step, 1 - 0.99**step
        weights -= fit.rate * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= fit.rate * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    every = np.zeros(1 << fit.bits, np.float32)
    every[kept] = weights
    return Model(every, float(bias), fit)


def score(docs: DataFrame, model: Model, text: str = "text", most: int = 3, at_least: float = 0.05, prefix: str = "") -> DataFrame:
    """`docs` with `score`, and `offending`: up to `most` sentences (number and score) of at least `at_least`, worst first; `prefix` stands before the new names."""
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)  # 2^bits numbers, a parameter
    bias, fit = model.bias, model.fit
    name = ("toxicity", uuid.uuid4().hex)  # of this model

    def values(part: pa.RecordBatch) -> list:
        bags = [sentences(t) for t in texts(part.column("text"))]
        sizes = np.array([len(s) for bag in bags for s in bag], np.int64)
        words = [w for bag in bags for s in bag for w in s]
        weight: dict[bytes, float] = remembered(name, dict)  # of words seen lately; those of all new words of a slice are added up at once
        if len(weight) > MEMO_WORDS:
            weight.clear()
        new = [w for w in set(words) if w not in weight]
        part_of, word_of = _parts(new, fit)
        weight.update(zip(new, np.bincount(word_of, weights.value[part_of], minlength=len(new)).tolist(), strict=True))
        each = looked_up(weight, words, float)
        logits = bias + np.bincount(np.repeat(np.arange(len(sizes)), sizes), each, minlength=len(sizes))
        at = starts(np.array([len(b) for b in bags], np.int64))
        total = -np.expm1(np.array([-np.logaddexp(0.0, logits[a:b]).sum() for a, b in zip(at[:-1], at[1:], strict=True)]))
        alone = 1 / (1 + np.exp(-np.clip(logits, -40, 40))) if np.isfinite(bias) else np.zeros(len(logits))
        found = [[] for _ in bags]
        for i in np.flatnonzero(alone >= at_least):
            d = int(np.searchsorted(at, i, side="right")) - 1
            found[d].append({"sentence": int(i - at[d]), "score": float(alone[i])})
        found = [sorted(f, key=lambda x: (-x["score"], x["sentence"]))[:most] for f in found]
        return [np.clip(total, 0.0, 1.0), found]

    return with_columns(docs, f"{prefix}score double, {prefix}offending array<struct<sentence:int,score:double>>", values, ["text"], [text])

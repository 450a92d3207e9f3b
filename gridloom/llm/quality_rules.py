"""Quality rules by distribution divergence.

References of each language are built from all documents: the share of each character class, and the share of the language's most
common words (the rest is one bucket). A document is compared with the reference of its own language by the Jensen-Shannon distance (square root
of the divergence in bits) and fails if it is further away than a limit; too short documents are not compared. A language of few documents or words
has no reference: its documents, and those without a language, are compared with the nearest one.

Defined cases: a null or empty text has no words and fails the base rule; repeated rows are treated alike; without any reference nothing is compared;
with no documents there are no references and no rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Memo, batch_of, mix, remembered, slices, starts, texts, with_columns

_WS = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_EDGES = b".,;:!?\"'()"
CLASSES = ("upper", "lower", "digit", "space", "point", "symbol", "other", "none")


def _class_of_byte() -> np.ndarray:
    """One class for each byte; a code point beyond ASCII counts once, by its first byte."""
    out = np.full(256, CLASSES.index("symbol"))
    for name, members in (("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("space", _WS), ("point", b".,;:!?'\"()-"),
                          ("other", range(0xC0, 0x100)), ("none", _CONTINUATION)):
        out[list(members)] = CLASSES.index(name)
    return out


BYTE_CLASS = np.eye(len(CLASSES))[_class_of_byte()][:, :-1]


@dataclass(frozen=True)
class Rules:
    """Limits of the two distances, the lengths below which a distance says nothing, and the least documents and words of a reference."""

    common_words: int = 40
    max_char_distance: float = 0.30
    max_word_distance: float = 0.37
    min_chars: int = 200
    min_words: int = 100
    min_reference_docs: int = 10
    min_reference_words: int = 2_000


def _classes(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ BYTE_CLASS


def _plain(word: bytes) -> bytes:
    return word.strip(_EDGES).lower()


def references(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """Per language with enough documents and words: `classes` (shares of character classes), `words` and `shares` (its most common words).

    Each task adds up its own rows first, so a language that holds most rows costs no more than another.
    """
    def count(batches):
        schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64()), ("classes", pa.list_(pa.float64())), ("docs", pa.int64())])
        for batch in batches:
            for part in slices(batch):
                total, by_word, n_docs = {}, {}, {}
                for name, t in zip(part.column("lang").to_pylist(), texts(part.column("text")), strict=True):
                    total[name] = total.get(name, 0) + _classes(t)
                    n_docs[name] = n_docs.get(name, 0) + 1
                    held = by_word.setdefault(name, {})
                    for w in t.split():
                        held[w] = held.get(w, 0) + 1
                for name, held in by_word.items():
                    plain: dict[bytes, int] = {}
                    for w, n in held.items():
                        plain[p] = plain.get(p := _plain(w), 0) + n
                    yield batch_of(schema, [name] * len(plain), list(plain), list(plain.values()), [None] * len(plain), [None] * len(plain))
                    yield batch_of(schema, [name], [None], [None], [list(total[name])], [n_docs[name]])

    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).mapInArrow(count, "lang string, word binary, n long, classes array<double>, docs long")
    names = CLASSES[:-1]
    # partial counts are summed before the shuffle; what is ranked is one row for each word of a language
    sums = rows.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), *[F.sum(F.col("classes")[i]).alias(c) for i, c in enumerate(names)])
    every = sums.groupBy("lang").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.array(*[F.sum(c) for c in names]).alias("classes"))
    every = every.filter((F.col("docs") >= rules.min_reference_docs) & (F.col("total") >= rules.min_reference_words)).drop("docs")
    # a bounded number of words for each hash part first, then of the few survivors: no task ranks a whole language
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("word"), F.lit(64))).orderBy(F.desc("n"), "word")
    whole = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = (sums.filter("length(word) > 0").select("lang", "word", "n", F.row_number().over(part).alias("r")).filter(F.col("r") <= rules.common_words)
           .select("lang", "word", "n", F.row_number().over(whole).alias("r")).filter(F.col("r") <= rules.common_words)
           .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "word", "n"))).alias("top")))
    return every.join(top, every["lang"].eqNullSafe(top["lang"]), "left").select(every["lang"], "total", "classes", "top")


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of rows, 0 (equal) to 1 (disjoint)."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = [np.where(x > 0, x * np.log2(np.where(x > 0, x / m, 1)), 0).sum(-1) for x in (p, q)]
    return np.sqrt(np.clip((d[0] + d[1]) / 2, 0, 1))


def repeated_words(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document, the words inside 3-word windows that occur twice or more in it; `ids` are word numbers, documents one after another."""
    doc, at = np.repeat(np.arange(len(lengths)), lengths), starts(lengths)
    out = np.zeros(len(ids) + 2, bool)
    if len(ids) >= 3:
        whole = doc[2:] == doc[:-2]
        key = mix(mix(mix(ids[:-2] + U64(1)) + ids[1:-1]) + ids[2:] + (doc[:-2].astype(U64) << U64(40)))
        key = mix(key + doc[:-2].astype(U64))
        place = np.flatnonzero(whole)
        order = place[np.argsort(key[place], kind="stable")]
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        hit = order[again]
        for k in range(3):
            out[hit + k] = True
    total = np.concatenate([[0], np.cumsum(out[:len(ids)])])
    return total[at[1:]] - total[at[:-1]]


def judge(docs: DataFrame, refs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """`docs` with the base counts, `char_distance`, `word_distance` (null where too short or without any reference), `base_failed` and `kept`; without a column `lang`, every document takes the nearest reference."""
    found = refs.collect()  # one row for each language, bounded by their number and `common_words`
    lists = [{r["word"]: i for i, r in enumerate(x["top"] or [])} for x in found]
    shares = []
    for x in found:
        own = np.array([r["n"] for r in x["top"] or []], float) / max(x["total"] or 0, 1)
        shares.append((np.array(x["classes"]) / max(sum(x["classes"]), 1), np.append(own, max(0.0, 1 - own.sum()))))
    place, named = {x["lang"]: k for k, x in enumerate(found)}, lang in docs.columns
    name = ("quality", uuid.uuid4().hex)  # of these references

    def values(part: pa.RecordBatch) -> list:
        near = remembered(name, lambda: Memo(lambda w: [m.get(_plain(w), -1) for m in lists]))
        bodies = texts(part.column("text"))
        split = [t.split() for t in bodies]
        n_words = np.array([len(w) for w in split], np.int64)
        word_chars = np.array([len(t.translate(None, _WS + _CONTINUATION)) for t in bodies], np.int64)
        n_symbols = np.array([len(t) - len(t.translate(None, _SYMBOLS)) for t in bodies], np.int64)
        dup = np.zeros(len(bodies), np.int64)
        for i, t in enumerate(bodies):
            if b"\n" in t:
                lines = [x for x in t.split(b"\n") if x.strip()]
                dup[i] = len(lines) - len(set(lines))
        number: dict[bytes, int] = {}
        flat = [w for ws in split for w in ws]
        ids = np.fromiter((number.setdefault(w, len(number)) for w in flat), U64, len(flat))
        repeats = repeated_words(ids, n_words)
        failed = (n_words < 50) | (100 * repeats > 50 * n_words)
        doc = np.repeat(np.arange(len(bodies)), n_words)
        by_class = np.array([_classes(t) for t in bodies]).reshape(len(bodies), len(CLASSES) - 1)
        p_class = by_class / np.maximum(by_class.sum(1, keepdims=True), 1)
        char_d, word_d = np.ones(len(bodies)), np.ones(len(bodies))
        marks = np.array([near[w] for w in number], np.int64).reshape(len(number), len(lists))[ids.astype(np.int64)] if number else np.zeros((0, len(lists)), np.int64)
        near.trim()
        own = np.array([place.get(x, -1) for x in part.column("lang").to_pylist()] if named else [-1] * len(bodies), np.int64)
        for k, (c, w) in enumerate(shares):
            asked = (own == k) | (own < 0)
            char_d = np.where(asked, np.minimum(char_d, distance(p_class, c)), char_d)
            width = len(w)
            slot = np.where(marks[:, k] < 0, width - 1, marks[:, k])
            hist = np.bincount(doc * width + slot, minlength=len(bodies) * width).reshape(len(bodies), width)
            word_d = np.where(asked, np.minimum(word_d, distance(hist / np.maximum(hist.sum(1, keepdims=True), 1), w)), word_d)
        long_c, long_w = (by_class.sum(1) >= rules.min_chars) & bool(shares), (n_words >= rules.min_words) & bool(shares)
        odd = (long_c & (char_d > rules.max_char_distance)) | (long_w & (word_d > rules.max_word_distance))
        return [n_words, word_chars, n_symbols, dup, repeats, [float(d) if k else None for d, k in zip(char_d, long_c, strict=True)],
                [float(d) if k else None for d, k in zip(word_d, long_w, strict=True)], failed, ~failed & ~odd]

    added = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, char_distance double, word_distance double, base_failed boolean, kept boolean"
    return with_columns(docs, added, values, ["lang", "text"] if named else ["text"], [lang, text] if named else [text])  # slices go by the last

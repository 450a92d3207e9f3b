"""Language-model scores by Katz backoff over word bigrams, from exact counts of all training documents.

P(w | h) = d(c(h,w)) c(h,w) / c(h) if the pair was seen in training, else alpha(h) P(w); P(w) = d(c(w)) c(w) / N, and what the discounts free is the
share of all unknown words as one type. d is Good-Turing for counts up to `k`; above, a count loses `tail`: nothing in Katz's own method (`KATZ`).
alpha(h) = (what h's discounts free) / (1 - sum of P(w) over the words seen after h) normalises exactly. A context whose pairs all keep their counts frees nothing; its
count is taken as one more, c(h) + 1, and so is N if no word is discounted.
The first word's context is the text's start, a text ends with one end token.

The corpus never meets in one place. A slice of documents is a chunk; its distinct words and pairs are dealt by hash to parts (each chunk sends a key once,
with its count), a part adds up the counts and answers each chunk for its keys in the order they came. Both tables of answers are partitioned and written. A pair is owned
by one chunk, which adds its probabilities to its context's sums; the sums are dealt by context, and each chunk is told the weights of the contexts it backs off from.
Then a chunk scores its documents. Keys are 48 bits of a 64-bit hash within their part.

Defined cases: a null or empty text is the end token alone; a repeated row is one more document; without training documents every probability is that of the one
unknown type, 1; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import cut
from .common import U64, batch_of, give_back, lean, looked_up, mix, slices, starts, texts, word_hashes
from .ngram_join import _from_six, _runs, _six

_LOW = U64((1 << 48) - 1)
_START = 0xA5A5A5A5A5A5A5A5 & 0x7FFFFFFFFFFFFFFF


@dataclass(frozen=True)
class Settings:
    """`k`: highest count with a Good-Turing discount; `tail`: what higher counts lose; `loss`: what counts up to `k` lose where the numbers of types give no discount
    between 0 and 1; `parts`: groups of keys (0: four for each shuffle partition)."""

    k: int = 5
    tail: float = 0.5
    loss: float = 0.5
    parts: int = 0
    slice_bytes: int = 8 << 20


#: Katz's own discounts: counts above five are reliable and lose nothing.
KATZ = Settings(tail=0.0)


@dataclass(frozen=True)
class Discount:
    """Discounts of one order, from the numbers of types that occur 1 .. k + 1 times."""

    types: tuple[int, ...]
    tail: float
    loss: float = 0.5

    def table(self) -> np.ndarray:
        n, k = np.array(self.types, float), len(self.types) - 1
        r = np.arange(1, k + 1)
        plain = (r - self.loss) / r
        with np.errstate(divide="ignore", invalid="ignore"):
            star, cut_ = (r + 1) * n[1:] / n[:-1] / r, (k + 1) * n[k] / n[0]
            turing = (star - cut_) / (1 - cut_)
        good = np.isfinite(turing) & (turing > 0) & (turing < 1)
        return np.concatenate([[0.0], np.where(good, turing, plain)])

    def __call__(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        t = self.table()
        return np.where(c < len(t), c * t[np.minimum(c, len(t) - 1)], c - self.tail)


@dataclass(frozen=True)
class Totals:
    tokens: int
    types: int
    documents: int
    words: Discount
    pairs: Discount
    freed: float  # tokens that the discounts take, the share of unknown words

    def word_probability(self, c: np.ndarray) -> np.ndarray:
        freed, tokens = (self.freed, self.tokens) if self.freed > 0 else (1.0, self.tokens + 1)
        return np.where(c > 0, self.words(c) / tokens, freed / tokens)


def _pack(x: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed."""
    raw = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), -1).T).tobytes()) if len(raw) else b""


def _unpack(raw: bytes, kind) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _key(h: np.ndarray, parts: int) -> np.ndarray:
    """A 64-bit key that sorts by part."""
    return (((h >> U64(32)) * U64(parts) >> U64(32)) << U64(48)) | (h & _LOW)


def _pairs(context: np.ndarray, word: np.ndarray, parts: int) -> np.ndarray:
    return _key(mix(mix(context) + word), parts)


def _contexts(word: np.ndarray, lengths: np.ndarray, start) -> np.ndarray:
    """What stands before each token; `start` at the beginning of a document."""
    out = np.empty_like(word)
    out[1:] = word[:-1]
    out[starts(lengths)[:-1]] = start
    return out


_ROWS = "part int, chunk long, ids array<long>, a binary, b binary, c binary, d binary"
_KINDS = [("part", pa.int32()), ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), *[(x, pa.binary()) for x in "abcd"]]


def _by_part(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    part = keys >> U64(48)
    cuts = _runs(part)
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(part[i]), int(i), int(j)


def _deal(docs: DataFrame, parts: int, s: Settings) -> DataFrame:
    """Per chunk and part: word keys, their training counts, pair keys, their counts; part < 0: the chunk's ids, held-out flags, lengths and tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, memo = pa.schema(_KINDS), word_hashes()
        chunk = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in batches:
            for piece in slices(batch, most=s.slice_bytes):
                split = [t.lower().split() for t in texts(piece.column("text"))]
                memo.trim()
                held = np.array(piece.column("held").to_pylist(), np.uint8)
                for w in split:
                    w.append(b"")  # the end token; no word is empty
                lengths = np.array([len(w) for w in split], np.int64)
                word = _key(looked_up(memo, [w for ws in split for w in ws], U64), parts)
                learn = np.repeat(held == 0, lengths)
                words, token = np.unique(word, return_inverse=True)
                pairs, pair = np.unique(_pairs(_contexts(word, lengths, U64(_START)), word, parts), return_inverse=True)
                nw = np.bincount(token, learn, len(words)).astype("<u4")
                np_ = np.bincount(pair, learn, len(pairs)).astype("<u4")
                rows = {p: [p, chunk, None, _six(words[i:j] & _LOW), _pack(nw[i:j]), b"", b""] for p, i, j in _by_part(words)}
                for p, i, j in _by_part(pairs):
                    rows.setdefault(p, [p, chunk, None, b"", b"", b"", b""])[5:] = [_six(pairs[i:j] & _LOW), _pack(np_[i:j])]
                own = [-1 - chunk % parts, chunk, piece.column("doc_id").to_pylist(), held.tobytes(), _pack(lengths.astype("<u4")), _pack(token.astype("<u4")), b""]
                yield batch_of(schema, *zip(own, *rows.values(), strict=True))
                chunk += 1
        give_back()

    return docs.mapInArrow(run, _ROWS)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Total count for each entry, whether it is its key's first, and the totals by key."""
    key, count = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(key, kind="stable")
    at = _runs(key[order])
    total = np.add.reduceat(count[order], at[:-1]) if len(key) else np.zeros(0, np.int64)
    each, first = np.empty(len(key), np.int64), np.zeros(len(key), bool)
    each[order] = np.repeat(total, np.diff(at))
    first[order[at[:-1]]] = True
    return each, first, total


def _count(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Answers to each chunk: its word keys with their counts, and for its pairs twice the count plus one for the owner; chunk -1: sums over the part."""
        if pdf["part"].iloc[0] < 0:
            return pdf
        pdf = pdf.sort_values("chunk")
        out, stats = {}, []
        for key, count in (("a", "b"), ("c", "d")):
            keys = [_from_six(x) for x in pdf[key]]
            each, first, total = _summed(keys, [_unpack(x, "<u4") for x in pdf[count]])
            at = starts(np.array([len(x) for x in keys]))
            value = each if key == "a" else 2 * each + first
            out[count] = [_pack(value[i:j].astype("<u8")) for i, j in zip(at[:-1], at[1:], strict=True)]
            seen = total[total > 0]
            stats += [*np.bincount(np.minimum(seen, k + 2), minlength=k + 3)[1:k + 2], seen.sum(), len(seen), (seen > k).sum()]
        made = pd.DataFrame({"part": pdf["part"], "chunk": pdf["chunk"], "ids": None, "a": pdf["a"], "b": out["b"], "c": b"", "d": out["d"]})
        one = pd.DataFrame({"part": [pdf["part"].iloc[0]], "chunk": [-1], "ids": None, "a": [np.array(stats, "<i8").tobytes()], "b": [b""], "c": [b""], "d": [b""]})
        return pd.concat([made, one], ignore_index=True)
    return run


def _totals(answers: DataFrame, documents: int, s: Settings) -> Totals:
    width, got = s.k + 4, np.zeros(2 * (s.k + 4), np.int64)
    for r in answers.filter("chunk = -1").select("a").collect():  # one row for each part
        got += np.frombuffer(r["a"], "<i8")
    words, pairs = (Discount(tuple(int(x) for x in got[i:i + s.k + 1]), s.tail, s.loss) for i in (0, width))
    t = words.table()
    freed = float(sum((1 - t[r]) * r * words.types[r - 1] for r in range(1, s.k + 1)) + s.tail * got[s.k + 3])
    return Totals(int(got[s.k + 1]), int(got[s.k + 2]), documents, words, pairs, freed)


def _own(pdf: pd.DataFrame) -> tuple[pd.Series, pd.DataFrame]:
    return pdf[pdf["part"] < 0].iloc[0], pdf[pdf["part"] >= 0].sort_values("part")


def _back_off(totals: Totals, parts: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Per part: contexts of this chunk with the sums over the pairs it owns; part < 0: what is already scored, and the contexts of unseen tokens."""
        own, rest = _own(pdf)
        words = np.concatenate([np.zeros(0, U64), *[_from_six(a) | (U64(p) << U64(48)) for p, a in zip(rest["part"], rest["a"], strict=True)]])
        cw = np.concatenate([_unpack(x, "<u8") for x in rest["b"]]).astype(np.int64)
        answer = np.concatenate([_unpack(x, "<u8") for x in rest["d"]]).astype(np.int64)
        lengths, token = _unpack(own["b"], "<u4").astype(np.int64), _unpack(own["c"], "<u4").astype(np.int64)
        last = len(words)  # the start of a text
        context = _contexts(token, lengths, last)
        names = np.append(words, U64(_START))
        _, where, pair = np.unique(_pairs(names[context], names[token], parts), return_index=True, return_inverse=True)
        c, owner = answer >> 1, (answer & 1) > 0
        ch = np.append(cw, totals.documents)
        p = totals.word_probability(cw)
        h, w = context[where], token[where]
        seen = (c > 0) & (ch[h] > 0)
        conditional = np.where(seen, totals.pairs(c) / np.maximum(ch[h], 1), 1.0)
        mine = seen & owner
        lost = np.where(seen, c - totals.pairs(c), 0.0)
        s1 = np.bincount(h[mine], lost[mine], last + 1)
        s2 = np.bincount(h[mine], p[w[mine]], last + 1)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        here = seen[pair]
        done = np.bincount(doc, np.where(here, np.log10(conditional)[pair], np.log10(np.maximum(p, 1e-300))[token]), len(lengths))
        base = np.bincount(doc, np.log10((cw + 0.5) / (totals.tokens + 0.5 * (totals.types + 1)))[token], len(lengths))
        known = np.bincount(doc, cw[token] > 0, len(lengths)).astype("<i8")
        behind = ~here & (ch[context] > 0)  # a context never seen in training has weight 1
        wanted = np.zeros(last + 1, bool)
        wanted[context[behind]] = True
        wanted[h[mine]] = True
        # contexts of which nothing here tells that they keep mass
        rich = np.zeros(last + 1, bool)
        rich[h[lost > 0]] = True
        full = here & ~rich[context]
        wanted[context[full]] = True
        place = np.flatnonzero(wanted)
        key = np.where(place < last, names[place], _key(names[-1:], parts)[0])
        order = np.argsort(key)
        place, key = place[order], key[order]
        local = np.full(last + 1, -1)
        local[place] = np.arange(len(place))
        rows = [(q, own["chunk"], None, _six(key[i:j] & _LOW), _pack(s1[place[i:j]]), _pack(s2[place[i:j]]), _pack(ch[place[i:j]].astype("<u8"))) for q, i, j in _by_part(key)]
        flat = np.stack([lengths.astype(float), known.astype(float), base, done]).tobytes()
        # tokens that need their context's answer: twice its place, plus one for a token whose pair was seen
        asks = behind | full
        rows.append((-1 - own["chunk"] % parts, own["chunk"], own["ids"], own["a"], flat, _pack(np.bincount(doc[asks], minlength=len(lengths)).astype("<u4")), _pack((2 * local[context] + here)[asks].astype("<u4"))))
        return pd.DataFrame(rows, columns=["part", "chunk", "ids", "a", "b", "c", "d"])
    return run


def _weights(pdf: pd.DataFrame) -> pd.DataFrame:
    """Answers to each chunk: log10 of its contexts' backoff weights, and of what their seen pairs lose if no discount frees anything."""
    if pdf["part"].iloc[0] < 0:
        return pdf
    pdf = pdf.sort_values("chunk")
    keys = [_from_six(x) for x in pdf["a"]]
    key = np.concatenate(keys)
    _, of = np.unique(key, return_inverse=True)
    s1, s2 = (np.bincount(of, np.concatenate([_unpack(x, "<f8") for x in pdf[c]])) for c in ("b", "c"))
    count = np.concatenate([_unpack(x, "<u8") for x in pdf["d"]]).astype(np.int64)
    spent = s1 == 0
    n = np.zeros(len(s1))
    n[of] = count
    alpha = np.log10(np.where(spent, 1 / (n + 1), s1 / n) / np.maximum(1 - s2, 1e-300))[of]
    less = np.where(spent, np.log10(n / (n + 1)), 0.0)[of]
    at = starts(np.array([len(x) for x in keys]))
    return pd.DataFrame({"part": pdf["part"], "chunk": pdf["chunk"], "ids": None, "a": b"", "b": [_pack(alpha[i:j].astype("<f8")) for i, j in zip(at[:-1], at[1:], strict=True)], "c": [_pack(less[i:j].astype("<f8")) for i, j in zip(at[:-1], at[1:], strict=True)], "d": b""})


def _score(totals: Totals):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, rest = _own(pdf)
        alpha = np.concatenate([np.zeros(0), *[_unpack(x, "<f8") for x in rest["b"]]])
        less = np.concatenate([np.zeros(0), *[_unpack(x, "<f8") for x in rest["c"]]])
        lengths, known, base, done = np.frombuffer(own["b"], float).reshape(4, -1)
        asks, context = _unpack(own["c"], "<u4").astype(np.int64), _unpack(own["d"], "<u4").astype(np.int64)
        more = np.bincount(np.repeat(np.arange(len(asks)), asks), np.where(context & 1, less[context >> 1], alpha[context >> 1]), len(lengths))
        return pd.DataFrame({"doc_id": pd.array(own["ids"], dtype="Int64"), "held_out": np.frombuffer(own["a"], np.uint8) > 0, "n_tokens": lengths.astype(np.int64), "n_known": known.astype(np.int64),
                             "train_tokens": totals.tokens, "base_score": base, "score": done + more})
    return run


def score(docs: DataFrame, held, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the documents where the column `held` is false, and score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    parts = s.parts or min(65_000, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    with lean(spark):
        answers = cut(_deal(rows, parts, s).groupBy("part").applyInPandas(_count(s.k), _ROWS), "counts")
        documents = rows.filter(~F.col("held")).count()
        totals = _totals(answers, documents, s)
        asked = answers.filter("chunk >= 0").groupBy("chunk").applyInPandas(_back_off(totals, parts), _ROWS)
        told = cut(asked.groupBy("part").applyInPandas(_weights, _ROWS), "weights")
    return told.groupBy("chunk").applyInPandas(_score(totals), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

"""Byte-pair encoding by a minimal acyclic transducer of frequent words, with exact merges for the rest, and decoding.

The most frequent pieces of the corpus (a piece is what stands between two spaces, with the space before it) are compiled into a minimal acyclic automaton: equal
suffixes are shared, and each arc carries the number of words that sort before those behind it, so the sum along a path is the word's rank. Ranks point into
a table of id sequences. The automaton is one byte string (sorted arc keys, targets, outputs, finals, id table) that each Python worker memory-maps from its
own copy. Pieces outside it are merged by the tokenizers library itself, once for each worker while its bounded memo lasts.

The lexicon's size is a parameter and only decides how fast a piece is found, never its ids.

Defined cases: a null or empty text has no ids and decodes to the empty text; a text with white space before a space between white spaces, or with a special
token's string, is encoded whole; repeated rows are encoded each; with no documents the lexicon is empty.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import cut
from .common import batch_of, lean, ragged, remembered, slices, starts, with_columns
from .importance import kth_largest
from .token_ids import Encoder, load

_FIELDS = (("keys", np.int64), ("targets", np.int32), ("outputs", np.int32), ("finals", np.uint8), ("begin", np.int32), ("ids", np.uint32))


@dataclass(frozen=True)
class Settings:
    words: int = 60_000
    memo: int = 300_000


def frequent(docs: DataFrame, n: int, text: str = "text") -> list[str]:
    """The most frequent pieces with a leading space over all documents, n at most; each task counts its slices first.

    Pieces tied with the one after the n-th are left out, so that no more than n rows reach the driver however many tasks there are.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("piece", pa.string()), ("n", pa.int64())])
        for batch in batches:
            for part in slices(batch, most=16 << 20):
                held: dict[str, int] = {}
                for t in part.column("text").to_pylist():
                    for p in (t or "").split(" ")[1:]:
                        held[p] = held.get(p, 0) + 1
                yield batch_of(schema, list(held), list(held.values()))

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "piece string, n long").filter("piece <> ''").groupBy("piece").agg(F.sum("n").alias("n"))
    with lean(docs.sparkSession):
        counted = cut(counted, "pieces")
    return [r["piece"] for r in counted.filter(F.col("n") > F.lit(kth_largest(counted, "n", n + 1))).select("piece").collect()] if n else []


def compile_words(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The minimal automaton of distinct words, as bytes; built from sorted words by sharing each finished state with an equal earlier one."""
    order = sorted(range(len(words)), key=words.__getitem__)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]  # unfinished states: final, arcs

    def close(state: list) -> int:
        made = (state[0], tuple(state[1]))
        if made not in register:
            register[made] = len(states)
            states.append(made)
        return register[made]

    last = b""
    for i in order:
        w = words[i]
        same = len(os.path.commonprefix([last, w]))
        for depth in range(len(last), same, -1):
            child = close(path.pop())
            path[-1][1].append((last[depth - 1], child))
        path.extend([False, []] for _ in range(len(w) - same))
        path[-1][0] = True
        last = w
    for depth in range(len(last), 0, -1):
        child = close(path.pop())
        path[-1][1].append((last[depth - 1], child))
    root = close(path[0])
    below = [0] * len(states)  # words behind a state; children are numbered before parents
    keys, targets, outputs = [], [], []
    for s, (final, arcs) in enumerate(states):
        passed = int(final)
        for byte, child in arcs:
            keys.append(s << 8 | byte)
            targets.append(child)
            outputs.append(passed)
            passed += below[child]
        below[s] = passed
    flat = [x for i in order for x in ids[i]]
    begin = starts(np.array([len(ids[i]) for i in order], np.int64))
    arrays = dict(zip((n for n, _ in _FIELDS), (keys, targets, outputs, [f for f, _ in states], begin, flat), strict=True))
    packed = [np.asarray(arrays[n], kind).tobytes() for n, kind in _FIELDS]
    head = np.array([root, *map(len, packed)], np.int64)
    pad = lambda b: b + bytes(-len(b) % 8)
    return head.tobytes() + b"".join(pad(p) for p in packed)


class Lexicon:
    """Ranks of words by walking the automaton, for many words at once."""

    def __init__(self, blob: bytes | mmap.mmap):
        head = np.frombuffer(blob, np.int64, len(_FIELDS) + 1)
        self.root, at = int(head[0]), head.nbytes
        for (name, kind), size in zip(_FIELDS, head[1:], strict=True):
            setattr(self, name, np.frombuffer(blob, kind, int(size) // np.dtype(kind).itemsize, at))
            at += int(size) + -int(size) % 8

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word among the sorted words, -1 for words outside."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text, at = np.frombuffer(b"".join(words), np.uint8), starts(lengths)[:-1]
        state, rank = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        if not len(self.keys):
            return np.full(len(words), -1)
        active = np.arange(len(words))
        depth = 0
        while True:
            active = active[(lengths[active] > depth) & (state[active] >= 0)]
            if not len(active):
                break
            key = state[active] << 8 | text[at[active] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            state[active] = np.where(hit, self.targets[arc], -1)
            rank[active] += np.where(hit, self.outputs[arc], 0)
            depth += 1
        known = (state >= 0) & (self.finals[np.maximum(state, 0)] > 0)
        return np.where(known, rank, -1)


def mapped(blob: bytes) -> Lexicon:
    """Memory-map a private copy; the file is unlinked at once and lives as long as the map."""
    with tempfile.TemporaryFile() as f:
        f.write(blob)
        f.flush()
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


class LexiconEncoder(Encoder):
    """An encoder that asks the automaton for pieces before it merges them."""

    def __init__(self, file: str, lexicon: Lexicon, most: int):
        self.lexicon = lexicon
        super().__init__(file, most)

    def learn(self, known: dict[str, int], pieces: list[str], prefix: str) -> None:
        if prefix:
            rank = self.lexicon.ranks([p.encode() for p in pieces])
            found = np.flatnonzero(rank >= 0)
            if len(found):
                lex = self.lexicon
                begin, end = lex.begin[rank[found]].astype(np.int64), lex.begin[rank[found] + 1].astype(np.int64)
                at = self.store.add(ragged(lex.ids, begin, end - begin), end - begin)
                names = [pieces[i] for i in found]
                known.update(zip(names, range(at, at + len(names)), strict=True))
                self.mark(at, names, True)
            pieces = [pieces[i] for i in np.flatnonzero(rank < 0)]
        if pieces:
            super().learn(known, pieces, prefix)


def build(docs: DataFrame, tokenizer: str, s: Settings = Settings(), text: str = "text") -> bytes:
    words = frequent(docs, s.words, text)
    flat, lengths = Encoder(tokenizer).encode([" " + w for w in words]) if words else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    at = starts(lengths)
    return compile_words([w.encode() for w in words], [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)])


def byte_table(tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids one after another, and where each begins; the byte alphabet is the tokenizer's own."""
    t = load(tokenizer)
    shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {i: a.content.encode() for i, a in t.get_added_tokens_decoder().items()}
    rows = [special[i] if i in special else bytes(byte_of[c] for c in t.id_to_token(i)) for i in range(t.get_vocab_size())]
    return np.frombuffer(b"".join(rows), np.uint8), starts(np.array([len(r) for r in rows], np.int64))


def encoded(docs: DataFrame, tokenizer: str, blob: bytes, s: Settings = Settings(), text: str = "text", with_ids: bool = True) -> DataFrame:
    """`docs` with n_tokens, ids_sha256, decoded_sha256, and with `with_ids` the ids and the decoded text."""
    sent = docs.sparkSession.sparkContext.broadcast(blob)  # bounded by the lexicon's size, a parameter
    name = ("lexicon", tokenizer, hashlib.sha256(blob).hexdigest())

    def values(part: pa.RecordBatch) -> list:
        encoder, flat, at = remembered(name, lambda: (LexiconEncoder(tokenizer, mapped(sent.value), s.memo), *byte_table(tokenizer)))
        ids, lengths = encoder([t or "" for t in part.column("text").to_pylist()])
        size = (at[1:] - at[:-1])[ids]
        raw = ragged(flat, at[:-1][ids], size).tobytes()
        docs_at = starts(lengths)
        bytes_at = starts(size)[docs_at]
        ids = ids.astype("<u4")
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(bytes_at[:-1], bytes_at[1:], strict=True)]
        own = [ids[a:b] for a, b in zip(docs_at[:-1], docs_at[1:], strict=True)]
        out = [lengths, [hashlib.sha256(x.tobytes()).hexdigest() for x in own], [hashlib.sha256(t.encode()).hexdigest() for t in texts]]
        return out + ([[x.tolist() for x in own], texts] if with_ids else [])

    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return with_columns(docs, added, values, ["text"], [text])

"""Cost-balanced packing of documents into sequences of fixed capacity.

The cost of a piece of n tokens is estimated as `linear * n + quadratic * n^2` (attention stays inside a document). Documents are packed in groups that one
task gathers as it reads: pieces are taken in descending order and each goes to the sequence of lowest cost that has room for it; where no sequence tried has
room for the whole piece, it is cut at what fits. A group's capacities add up to its tokens (full sequences, and powers of two for the rest), so nothing is padded
except by the caller's own rule.

Groups need no shuffle and are bounded by `group_tokens` (more only for one longer document), so their number grows with the data.

Defined cases: a null or empty text is the end token alone; repeated rows are packed each; an empty table gives no sequences.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, give_back, slices, starts
from .token_ids import encoder as encoder_of


@dataclass(frozen=True)
class Plan:
    capacity: int = 2048
    linear: float = 1.0
    quadratic: float = 1.0 / 1024
    group_tokens: int = 1 << 20
    memo: int = 250_000  # pieces whose ids a worker remembers; less memory, more work


def capacities(total: int, capacity: int) -> list[int]:
    """Full sequences, then powers of two; the sum is `total`."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


class Open:
    """Open sequences by room: the one of lowest cost among those with at least n ids of room, exactly.

    Heaps of (cost, sequence), one for each amount of room, are the leaves of a tree whose inner nodes hold the least of their two.
    """

    NONE = (math.inf, -1)

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.heaps: list[list] = [[] for _ in range(self.size)]
        self.tree = [self.NONE] * (2 * self.size)

    def _mend(self, room: int) -> None:
        i = room + self.size
        self.tree[i] = self.heaps[room][0] if self.heaps[room] else self.NONE
        while i > 1:
            i >>= 1
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def add(self, room: int, cost: float, sequence: int) -> None:
        heapq.heappush(self.heaps[room], (cost, sequence))
        self._mend(room)

    def cheapest(self, room: int) -> tuple[float, int]:
        """Cost and sequence, or NONE."""
        best, a, b = self.NONE, room + self.size, 2 * self.size
        while a < b:
            if a & 1:
                best, a = min(best, self.tree[a]), a + 1
            a, b = a >> 1, b >> 1  # b is a power of two
        return best

    def take(self, room: int) -> None:
        """Remove the least of those with exactly that room."""
        heapq.heappop(self.heaps[room])
        self._mend(room)


def pack(lengths: np.ndarray, plan: Plan = Plan()) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of the given lengths; equal costs go by sequence, equal lengths by document."""
    room = capacities(int(lengths.sum()), plan.capacity)
    out, filled = [], [0] * len(room)
    cost = lambda n: plan.linear * n + plan.quadratic * n * n
    pieces, full = [], 0
    for d in np.argsort(-lengths, kind="stable"):
        at, n = 0, int(lengths[d])
        while n - at >= plan.capacity:  # a full piece is a sequence of its own
            out.append((int(d), at, plan.capacity, full, 0))
            full, at = full + 1, at + plan.capacity
        if n > at:
            pieces.append((int(d), at, n - at))
    open_ = Open(plan.capacity)
    for s in range(full, len(room)):
        open_.add(room[s], 0.0, s)
    for d, at, n in sorted(pieces, key=lambda p: -p[2]):
        while n:
            c, s = open_.cheapest(n)
            if s < 0:
                c, s = open_.cheapest(1)
            left = room[s] - filled[s]
            open_.take(left)
            take = min(n, left)
            out.append((d, at, take, s, filled[s]))
            filled[s] += take
            if take < left:
                open_.add(left - take, c + cost(take), s)
            at, n = at + take, n - take
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, capacity long, cost double, ids array<int>"


def packed(docs: DataFrame, tokenizer: str, end_id: int, plan: Plan = Plan(), key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row for each piece of a document; `cost` is the estimated cost of its whole sequence, `capacity` the sequence's length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
                            ("offset", pa.int64()), ("capacity", pa.int64()), ("cost", pa.float64()), ("ids", pa.list_(pa.int32()))])
        encoder, keys, held, size = encoder_of(tokenizer, plan.memo), [], [], 0
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36

        def emit() -> pa.RecordBatch:
            nonlocal number
            lengths = np.array([len(x) for x in held], np.int64)
            rows = sorted(pack(lengths, plan), key=lambda r: (r[3], r[4]))
            d, start, length, seq, offset = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            cost = np.bincount(seq, plan.linear * length + plan.quadratic * length * length)
            total = np.bincount(seq, length).astype(np.int64)
            parts = [held[i][a:a + n] for i, a, n in zip(d, start, length, strict=True)]
            crc = [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]
            ids = pa.ListArray.from_arrays(pa.array(starts(length), pa.int32()), pa.array(np.concatenate(parts).astype(np.int32))) if with_ids else pa.nulls(len(rows), pa.list_(pa.int32()))
            out = batch_of(schema, [keys[i] for i in d], start, length, crc, lengths[d], seq + number, offset, total[seq], cost[seq], ids)
            number += len(total)
            return out

        for batch in batches:
            for part in slices(batch):
                ids, lengths = encoder([t or "" for t in part.column("text").to_pylist()])
                at = starts(lengths)
                for k, a, b in zip(part.column("doc_id").to_pylist(), at[:-1], at[1:], strict=True):
                    keys.append(k)
                    held.append(np.append(ids[a:b], np.uint32(end_id)))
                    size += b - a + 1
                    if size >= plan.group_tokens:
                        yield emit()
                        keys, held, size = [], [], 0
        if held:
            yield emit()
        held.clear()
        give_back()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
    return rows if with_ids else rows.drop("ids")

"""Exact top-k dot-product neighbours against a bank, and the scores built on them.

Queries and bank are written once as blocks, one row each with its ids and vectors as bytes. The blocks of the bank stream past the blocks of the queries:
each task reads one file part of both tables and works on block pairs by matrix multiplication, holding one block of either side and the k best rows of the
present query block. Neither table is shuffled, no pair of rows is ever a row, and nothing passes through the driver; only k rows a query and task are merged.

Products of a matrix multiplication depend on block shapes in their last digits, so whatever is within their error of the k-th is computed again by one fixed
formula, and only that decides: results are the same for every block size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import cut

# one block of vectors
BLOCK_BYTES = 4 << 20
# similarities at a time
_CELLS = 1 << 20
_BLOCK = "ids binary, vecs binary, n int"


def blocks(vectors: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(vec_id, vec) rows as blocks of about `block_bytes`; vectors are of one length."""
    schema = pa.schema([("ids", pa.binary()), ("vecs", pa.binary()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs, size = [], [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((np.concatenate(ids).tobytes(), np.concatenate(vecs).tobytes(), sum(map(len, ids))), schema)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("vec").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            width, number = len(flat) // batch.num_rows, batch.column("vec_id").to_numpy(zero_copy_only=False)
            rows, at = max(1, block_bytes // (8 * max(width, 1))), 0
            while at < batch.num_rows:
                end = min(batch.num_rows, at + rows - size)
                ids.append(number[at:end])
                vecs.append(flat[at * width:end * width])
                size, at = size + end - at, end
                if size >= rows:
                    yield block()
                    ids, vecs, size = [], [], 0
        if size:
            yield block()

    return vectors.select("vec_id", "vec").mapInArrow(run, _BLOCK)


class Best:
    """The k best bank rows of each query of a block so far: most similar first, then the smaller id."""

    def __init__(self, ids: bytes, vecs: bytes, k: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.q, self.k = np.frombuffer(vecs, np.float64).reshape(len(self.ids), -1), k
        self.far = np.sqrt((self.q * self.q).sum(1).max(initial=0))
        self.row, self.bank, self.sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(self.ids), -np.inf)

    def meet(self, ids: bytes, vecs: bytes) -> None:
        bank = np.frombuffer(ids, np.int64)
        b = np.frombuffer(vecs, np.float64).reshape(len(bank), -1)
        error = 4e-16 * b.shape[1] * self.far * np.sqrt((b * b).sum(1).max(initial=0))
        k, step = min(self.k, len(bank)), max(1, _CELLS // len(bank))
        for start in range(0, len(self.q), step):
            s = self.q[start:start + step] @ b.T
            floor = np.maximum(np.partition(s, len(bank) - k, axis=1)[:, len(bank) - k], self.least[start:start + step])
            r, c = np.nonzero(s >= (floor - 2 * error)[:, None])
            # one order of additions whatever the blocks are
            self.merge(r + start, bank[c], np.einsum("ij,ij->i", self.q[r + start], b[c]))

    def merge(self, row: np.ndarray, bank: np.ndarray, sim: np.ndarray) -> None:
        low, high = row.min(initial=len(self.q)), row.max(initial=-1)
        near = (self.row >= low) & (self.row <= high)
        row, bank, sim = (np.concatenate([x[near], y]) for x, y in ((self.row, row), (self.bank, bank), (self.sim, sim)))
        order = np.lexsort((bank, -sim, row))
        row, bank, sim = row[order], bank[order], sim[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        full = place == self.k - 1
        self.least[row[full]] = sim[full]
        self.row, self.bank, self.sim = (np.concatenate([x[~near], y[keep]]) for x, y in ((self.row, row), (self.bank, bank), (self.sim, sim)))


def _pairs(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("bank_id", pa.int64()), ("sim", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None
        for batch in batches:
            for q_ids, q_vecs, b_ids, b_vecs in zip(*(batch.column(c) for c in ("q_ids", "q_vecs", "b_ids", "b_vecs")), strict=True):
                key = q_ids.as_py()
                if key != now:
                    if best:
                        yield pa.RecordBatch.from_arrays([best.ids[best.row], best.bank, best.sim], schema=schema)
                    now, best = key, Best(key, q_vecs.as_py(), k)
                best.meet(b_ids.as_py(), b_vecs.as_py())
        if best:
            yield pa.RecordBatch.from_arrays([best.ids[best.row], best.bank, best.sim], schema=schema)

    return run


def topk(queries: DataFrame, bank: DataFrame, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, bank_id, sim) with min(k, bank rows) neighbours; both inputs have (vec_id BIGINT, vec ARRAY)."""
    def side(df: DataFrame, name: str) -> DataFrame:
        packed = cut(blocks(df.select(F.col("vec_id").cast("bigint").alias("vec_id"), "vec"), block_bytes), name)
        return packed.select(*[F.col(c).alias(f"{name}_{c}") for c in ("ids", "vecs")])

    # rows are blocks here: a stated query set against the whole bank
    part = side(queries, "q").crossJoin(side(bank, "b")).mapInArrow(_pairs(k), "query_id bigint, bank_id bigint, sim double")
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "bank_id")
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "bank_id", "sim")


def mean_topk(neighbours: DataFrame, k: int, name: str) -> DataFrame:
    return neighbours.filter(F.col("rank") <= k).groupBy("query_id").agg(F.avg("sim").alias(name))


def knn_score(queries: DataFrame, pos: DataFrame, neg: DataFrame | None, k: int, alpha: float) -> DataFrame:
    """mean(top-k positive) - alpha * mean(top-k negative); positives only when there is no negative bank."""
    out = mean_topk(topk(queries, pos, k), k, "pos")
    if neg is None:
        return out.select("query_id", F.col("pos").alias("score"))
    return (out.join(mean_topk(topk(queries, neg, k), k, "neg"), "query_id", "left")
            .select("query_id", (F.col("pos") - F.lit(float(alpha)) * F.coalesce("neg", F.lit(0.0))).alias("score")))


def knn_saliency(neighbours: DataFrame) -> DataFrame:
    """Similarity-weighted mean similarity of the positive neighbours."""
    s = F.col("sim")
    return neighbours.groupBy("query_id").agg((F.sum(s * s) / (F.sum(s) + 1e-8)).alias("saliency"))

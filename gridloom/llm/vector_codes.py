"""Product codes of integer vectors with exact assignment: limb-split GEMM and first argmin.

A component x becomes floor(scale * x); a vector is cut into equal parts and every part gets the number of its codebook's nearest entry. Nearest is decided
in whole numbers: integers are split into limbs so short that a float64 matrix product of two limbs stays below 2^53 and is exact, the products are added up
as int64, and |c|^2 - 2 x.c is compared, the first least entry winning. Results thus depend neither on the order of rows nor on the BLAS library.

A round reads the written integer vectors once; a task returns sums and counts for each entry it used (at most parts x entries rows), which are added up by
entry. Codebooks are parameters of fixed size; only they and the sums of their entries reach the driver.

Defined cases: null vectors and those with a null or non-finite component are dropped; vectors shorter than the longest, and lengths that do not divide into
parts, count as filled up with zeros; null ids come after all others; repeated ids are rows of their own, ordered by vector; with fewer vectors than entries a
codebook is shorter; an empty table gives no rows; integers too large for int64 products are compared as Python integers, and an error that no
long holds is null; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import cut
from .common import batch_of


@dataclass(frozen=True)
class Codes:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    limb_bits: int | None = None  # of a limb; as many as 2^53 allows if not given
    label_bytes: int = 16 << 20  # totals of labels up to this size are broadcast
    salts: int = 32  # larger ones are joined by label and salt


def limb_bits(width: int) -> int:
    """Bits of a limb such that `width` products of two limbs add up to less than 2^53."""
    return (52 - max(width - 1, 0).bit_length()) // 2


def limbs(x: np.ndarray, bits: int, count: int) -> list[np.ndarray]:
    """float64 limbs of int64 numbers, low ones first; the last carries the sign."""
    out = [((x >> (bits * k)) & ((1 << bits) - 1)).astype(np.float64) for k in range(count - 1)]
    return [*out, (x >> (bits * (count - 1))).astype(np.float64)]


def products(x: np.ndarray, c: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Exact x @ c.T of int64 matrices whose products fit int64."""
    width = x.shape[1]
    bits = bits or limb_bits(width)

    def split(a: np.ndarray) -> list[np.ndarray]:
        most = int(max(a.max(initial=0), -(a.min(initial=0) + 1)))
        return limbs(a, bits, max(1, -(-most.bit_length() // bits)))

    out = np.zeros((len(x), len(c)), np.int64)
    low = [b.T.copy() for b in split(c)]
    for i, a in enumerate(split(x)):
        for j, b in enumerate(low):
            out += (a @ b).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, c: np.ndarray, bits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number of the first nearest row of `c` for each row of `x`, and the squared distances."""
    most = max(int(np.abs(a).max(initial=0)) for a in (x, c))
    if 4 * x.shape[1] * (most + 1) ** 2 < 1 << 63:
        x, c = x.astype(np.int64), c.astype(np.int64)
        score = (c * c).sum(1) - 2 * products(x, c, bits)
    else:
        x, c = x.astype(object), c.astype(object)
        score = (c * c).sum(1)[None, :] - 2 * x.dot(c.T)
    at = np.argmin(score, axis=1)
    return at, (x * x).sum(1) + score[np.arange(len(x)), at]


def floors(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows are kept, and their components as float64 whole numbers."""
    vectors = batch.column("v")
    flat = vectors.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    good = vectors.is_valid().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good &= bad[ends] == bad[ends - sizes]
    with np.errstate(over="ignore"):
        whole = np.floor(flat * scale)
    return good, [whole[e - n:e] for e, n, g in zip(ends, sizes, good, strict=True) if g]


def integers(df: DataFrame, codes: Codes, key: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, ints (floors as doubles, which are exact)."""
    rows = df.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("v"))
    kinds = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, found = floors(batch, codes.scale)
            left = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([left.column("vec_id"), left.column("label"), pa.array(found, pa.list_(pa.float64()))], ["vec_id", "label", "ints"])

    return rows.mapInArrow(run, f"vec_id {kinds['vec_id'].dataType.simpleString()}, label {kinds['label'].dataType.simpleString()}, ints array<double>")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows filled up with zeros to `width`, as integers."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        out = flat.reshape(-1, width)
    else:
        out = np.zeros((len(sizes), width))
        out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out.astype(np.int64) if np.abs(out).max(initial=0) < 2.0**60 else np.vectorize(int, otypes=[object])(out)


@dataclass(frozen=True)
class Model:
    books: np.ndarray  # parts x entries x width of a part
    codes: Codes

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def _parts(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    width = books.shape[2]
    x = matrix(batch.column("ints"), books.shape[0] * width)
    for p in range(books.shape[0]):
        yield p, x[:, p * width:(p + 1) * width]


def _smallest(rows: DataFrame, n: int) -> list:
    """The vectors of the `n` smallest ids: ids alone find the limit, ties of the last id are ordered by vector."""
    order = [F.col("vec_id").asc_nulls_last()]
    ids = [r["vec_id"] for r in rows.select("vec_id").orderBy(*order).limit(n).collect()]
    within = rows if not ids or ids[-1] is None else rows.filter(F.col("vec_id") <= F.lit(ids[-1]))
    return [r["ints"] for r in within.orderBy(*order, "ints").limit(n).collect()]


def _totals(rows: DataFrame, model: Model) -> list:
    """Count and sums of the parts that each entry is nearest to; at most parts x entries rows reach the driver."""
    held = rows.sparkSession.sparkContext.broadcast(model.books)
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.string())])
    bits = model.codes.limb_bits

    def out(found: dict) -> Iterator[pa.RecordBatch]:
        if found:
            yield batch_of(schema, [p for p, _ in found], [e for _, e in found], [n for n, _ in found.values()], [",".join(map(str, s.tolist())) for _, s in found.values()])

    def add(found: dict, key: tuple[int, int], n: int, sums: np.ndarray) -> None:
        n0, before = found.get(key, (0, None))
        found[key] = n0 + n, sums if before is None else before + sums

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            for p, x in _parts(batch, held.value):
                at, _ = nearest(x, held.value[p], bits)
                order = np.argsort(at, kind="stable")
                entries, first = np.unique(at[order], return_index=True)
                small = x.dtype != object and float(np.abs(x).max(initial=0)) * len(x) < 2.0**62
                sums = np.add.reduceat(x[order] if small else x[order].astype(object), first, axis=0)
                for e, n, s in zip(entries.tolist(), np.diff(first, append=len(order)).tolist(), sums, strict=True):
                    add(found, (p, e), n, s.astype(object))
        yield from out(found)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            for p, e, n, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                add(found, (p, e), n, np.array([int(v) for v in s.split(",")], object))
        yield from out(found)

    schema_ = "part int, entry int, n long, sums string"
    return rows.select("ints").mapInArrow(count, schema_).repartition("part", "entry").mapInArrow(merge, schema_).collect()


def train(rows: DataFrame, codes: Codes = Codes()) -> Model:
    """Codebooks after `rounds` rounds over all integer vectors (a table, as it is read many times)."""
    longest = rows.agg(F.max(F.size("ints"))).first()[0] or 0
    width = max(1, -(-longest // codes.parts))
    first = np.zeros((0, codes.parts * width), object)
    seeds = _smallest(rows, codes.entries)
    if seeds:
        first = np.array([[int(v) for v in s] + [0] * (codes.parts * width - len(s)) for s in seeds], object)
    books = first.reshape(-1, codes.parts, width).transpose(1, 0, 2).copy()
    for _ in range(codes.rounds if len(first) else 0):
        for r in _totals(rows, Model(books, codes)):
            books[r["part"], r["entry"]] = [int(v) // r["n"] for v in r["sums"].split(",")]  # // goes down
    return Model(books, codes)


def encode(rows: DataFrame, model: Model) -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error."""
    held = rows.sparkSession.sparkContext.broadcast(model.books)
    bits, kinds = model.codes.limb_bits, rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest(x, held.value[p], bits) for p, x in _parts(batch, held.value)]
            error = np.sum([d.astype(object) for _, d in found], axis=0)
            code = ["".join(f"{e:02x}" for e in row) for row in np.stack([a for a, _ in found], 1).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id {kinds['vec_id'].dataType.simpleString()}, label {kinds['label'].dataType.simpleString()}, code string, error long")


def with_label_error(coded: DataFrame, codes: Codes = Codes()) -> DataFrame:
    """`coded` (a table) with the error summed over equal labels, nulls together; a label of any share of the rows is pre-aggregated and, if not broadcast, salted."""
    total = F.try_sum(F.col("error")).cast("long").alias("label_error")
    totals = cut(coded.groupBy("label").agg(total), "labels").withColumnRenamed("label", "of")
    size = totals.agg((F.sum(F.coalesce(F.length(F.col("of").cast("string")), F.lit(0))) + 24 * F.count(F.lit(1))).alias("b")).first()["b"] or 0
    same = F.col("label").eqNullSafe(F.col("of"))
    if size <= codes.label_bytes:
        return coded.join(F.broadcast(totals), same).drop("of")
    left = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(codes.salts)).cast("int"))
    right = totals.withColumn("salted", F.explode(F.sequence(F.lit(0), F.lit(codes.salts - 1))))
    return left.join(right.hint("shuffle_hash"), same & (F.col("salt") == F.col("salted"))).drop("of", "salt", "salted")


def compressed(df: DataFrame, codes: Codes = Codes(), key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector."""
    rows = cut(integers(df, codes, key, vector, label), "integers")
    model = train(rows, codes)
    coded = cut(encode(rows, model), "coded")
    return with_label_error(coded, codes).select("vec_id", "code", "error", "label_error", F.lit(model.sha256()).alias("codebooks_sha256"))

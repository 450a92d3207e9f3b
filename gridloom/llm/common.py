"""Helpers shared by the operators: words as bytes, 64-bit hashes, bounded slices of Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch are handled in slices of at most this many bytes of text (one longer text is a slice of its own).
SLICE_BYTES = 2 << 20
#: And of at most this many rows, so that a row's number in its slice fits 16 bits with room for marks.
SLICE_ROWS = 60_000
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Steps that end in a written table give up their shuffle files as soon as it is written, and send Python workers at most 1,000 rows at once, so that
    neither side of the pipe holds ten thousand texts; the session's own choices come back afterwards."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    most = int(spark.conf.get(rows))
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", rows: str(min(most, 1000) if most > 0 else 1000)}
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in slices of bounded text and number."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most or i - begin >= rows:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(n)
    yield batch.slice(begin)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the finaliser of a public-domain generator)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_MEMO: dict = {}


def remembered(name, make: Callable):
    """What a Python worker remembers from one task to the next: one thing at a time.

    Workers outlive tasks and stages, so whatever another operator has left is dropped, and its memory given back, before `make` starts a new memo.
    """
    if name not in _MEMO:
        if _MEMO:
            _MEMO.clear()
            give_back()
        _MEMO[name] = make()
    return _MEMO[name]


def give_back() -> None:
    """Return freed memory to the system; allocators keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Memo(dict):
    """A table filled on demand from `value(key)`; `trim` empties it between slices once it holds more than `most` keys."""

    def __init__(self, value: Callable, most: int = 400_000):
        super().__init__()
        self.value, self.most = value, most

    def __missing__(self, key):
        self[key] = out = self.value(key)
        return out

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


def word_hashes() -> Memo:
    """64-bit hash of a word's bytes; equal words have equal hashes, and 64 bits make other cases negligible."""
    return remembered("word hashes", lambda: Memo(xxhash.xxh3_64_intdigest, 50_000))


def looked_up(memo: dict, keys: list, kind) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, keys), dtype=kind, count=len(keys))


def starts(lengths: np.ndarray) -> np.ndarray:
    """Offset of each run, and the total at the end."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ragged(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of flat[begin : begin + length] over all rows."""
    at = starts(length)
    step = np.repeat(begin - at[:-1], length)
    step += np.arange(at[-1])
    return flat[step]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def with_columns(df: DataFrame, added: str, values: Callable[[pa.RecordBatch], list], names: list[str], cols: list[str]) -> DataFrame:
    """`df` with columns computed from slices of its rows; a column of the same name is replaced.

    `values` gets a slice that has `names` (the columns of `df` listed in `cols`, renamed) and returns one array for each added column.
    """
    new = T._parse_datatype_string(added)
    kept = [c for c in df.columns if c not in new.names]
    inner = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(f"__in_{n}") for c, n in zip(cols, names, strict=True)])
    schema = T.StructType([*df.select(*[f"`{c}`" for c in kept]).schema.fields, *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in new.fields]
        for batch in batches:
            for part in slices(batch, f"__in_{names[-1]}"):
                given = pa.RecordBatch.from_arrays([part.column(f"__in_{n}") for n in names], names=names)
                made = values(given)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *[pa.array(v, type=k) for v, k in zip(made, kinds, strict=True)]], names=[*kept, *new.names])
        give_back()  # the worker waits for other tasks

    return inner.mapInArrow(run, schema)


def by_key(batches: Iterator[pa.RecordBatch], single: bool = False) -> Iterator[tuple]:
    """Sorted rows as tuples, grouped by their first column, one row at a time; with `single` each row is a group. A group must be used up before the next."""
    rows = (row for batch in batches for start in range(0, batch.num_rows, 256) for row in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True))
    return ((row[0], iter((row,))) for row in rows) if single else groupby(rows, key=itemgetter(0))


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow's form of a schema (on the driver)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def sized(rows: Iterator[tuple], kinds: pa.Schema, text: int | None = None, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most 4,096 rows and about `most` characters of the column numbered `text`."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text]) if text is not None else 0
        if len(held) == 4096 or size >= most:
            yield batch_of(kinds, *zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield batch_of(kinds, *zip(*held, strict=True))

"""Token ids in files of shuffled byte or bit planes.

Ids are cut into blocks of fixed size. A block's ids (32 bits, little-endian) are transposed, so that equal bytes (or bits) of all ids stand together, and each
plane is compressed with zstandard. A segment holds whole documents in order: its blocks' planes one after another, the chunk index (where each
plane begins and how long it is) and the documents' lengths. Segments are rows of Parquet files, so Spark's own writer commits them and any
store that Spark writes to will do; a segment is read on its own, and the index gives any block without decompressing others.

Documents are range-partitioned by id and sorted inside a partition; a partition is a shard. Only one number for each shard (its ids) is summed up in one
task to get the positions in the whole stream.

Defined cases: a null or empty text is the end id alone; a null id sorts first; repeated rows are written each; an empty table is an
empty folder of files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_of, slices, starts
from .token_ids import encoder as encoder_of

SEGMENT = "shard long, segment long, first long, n_ids long, doc_ids array<long>, doc_lengths array<int>, chunk_offset array<int>, chunk_length array<int>, block int, mode string, payload binary"
ROW = "shard long, doc_id long, in_shard long, n_tokens long, ids_crc32 long"


@dataclass(frozen=True)
class Format:
    block: int = 1 << 16
    mode: str = "byte"  # or "bit"
    level: int = 3
    segment_ids: int = 1 << 19  # a segment ends after the document that reaches it


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    if mode == "byte":
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4").astype(np.uint32)
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little", count=n) for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4").astype(np.uint32)


def write_segment(ids: np.ndarray, f: Format) -> tuple[bytes, list[int], list[int]]:
    """Payload, and offset and length of each chunk in it, plane by plane within block by block."""
    press = zstandard.ZstdCompressor(level=f.level)
    chunks = [press.compress(p) for a in range(0, len(ids), f.block) for p in to_planes(ids[a:a + f.block], f.mode)]
    lengths = [len(c) for c in chunks]
    return b"".join(chunks), list(starts(np.array(lengths, np.int64))[:-1]), lengths


def read_block(payload: bytes, offsets: list[int], lengths: list[int], n_ids: int, block: int, mode: str, k: int) -> np.ndarray:
    """Block k of a segment, by the chunk index alone."""
    width, n = (4 if mode == "byte" else 32), min(block, n_ids - k * block)
    open_ = zstandard.ZstdDecompressor()
    planes = [open_.decompress(payload[offsets[i]:offsets[i] + lengths[i]]) for i in range(k * width, (k + 1) * width)]
    return from_planes(planes, n, mode)


def read_segment(payload: bytes, offsets: list[int], lengths: list[int], n_ids: int, block: int, mode: str) -> np.ndarray:
    blocks = [read_block(payload, offsets, lengths, n_ids, block, mode, k) for k in range(-(-n_ids // block))]
    return np.concatenate(blocks) if blocks else np.zeros(0, np.uint32)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, f: Format = Format(), key: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts, end id after each, and write the files in ascending order of the id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("segment", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int32())),
                            ("chunk_offset", pa.list_(pa.int32())), ("chunk_length", pa.list_(pa.int32())), ("block", pa.int32()), ("mode", pa.string()), ("payload", pa.binary())])
        encoder, shard = encoder_of(tokenizer), TaskContext.get().partitionId() if TaskContext.get() else 0
        keys, held, size, segment, first = [], [], 0, 0, 0

        def emit() -> pa.RecordBatch:
            nonlocal segment, first
            ids = np.concatenate(held)
            payload, offsets, lengths = write_segment(ids, f)
            out = batch_of(schema, [shard], [segment], [first], [len(ids)], [keys], [[len(x) for x in held]], [offsets], [lengths], [f.block], [f.mode], [payload])
            segment, first = segment + 1, first + len(ids)
            return out

        for batch in batches:
            for part in slices(batch):
                ids, lengths = encoder([t or "" for t in part.column("text").to_pylist()])
                at = starts(lengths)
                for k, a, b in zip(part.column("doc_id").to_pylist(), at[:-1], at[1:], strict=True):
                    keys.append(k)
                    held.append(np.append(ids[a:b], np.uint32(end_id)))
                    size += b - a + 1
                    if size >= f.segment_ids:
                        yield emit()
                        keys, held, size = [], [], 0
        if held:
            yield emit()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tie = F.xxhash64("text")  # splits an id that many rows share
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    ordered.mapInArrow(run, SEGMENT).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("in_shard", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                ids = read_segment(r["payload"], r["chunk_offset"], r["chunk_length"], r["n_ids"], r["block"], r["mode"])
                lengths = np.array(r["doc_lengths"], np.int64)
                at = starts(lengths)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield batch_of(schema, [r["shard"]] * len(crc), r["doc_ids"], at[:-1] + r["first"], lengths, crc)

    files = spark.read.schema(SEGMENT).parquet(folder)
    # one row for each shard
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = totals.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))
    docs = files.mapInArrow(run, ROW)
    return docs.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32")

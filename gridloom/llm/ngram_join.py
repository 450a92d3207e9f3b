"""Jaccard self-join on word shingles by prefix filters under several global token orders.

If two sets have Jaccard similarity t or more, then under any global order of tokens their prefixes of n - ceil(t n) + 1 tokens share one. Two orders
are used, both rarest first: by document frequency (exact up to 5,535 documents a chunk) then hash, and by the logarithm of the frequency then another hash. A pair is verified only if
its prefixes meet under both.

1. Read: each slice of documents is a chunk. Its distinct shingle hashes are dealt by hash to `parts` groups as packed numbers; a shingle that many documents of
   the chunk share travels once. A group counts documents for each shingle and answers each chunk with the shingles that two or more documents have; the
   others fill the front of every prefix, and a document with too few shared shingles cannot link and drops out here.
2. Equal sets are one class. Postings of the first order's prefixes give each shingle's documents; each document is compared with the shingle's pivot, the document
   with the smallest share of unshared shingles (the original of a family of copies). Links found this way are contracted.
3. What is left are pairs of different components: from small posting lists as pairs, from crowded ones as blocks of documents that tasks compare at once,
   returning a forest and never the pairs. Then all links are contracted.

Shingles are 64-bit hashes; of each hash 48 bits and its group are kept, some 55 bits at the smallest number of groups and more as that grows.

Defined cases: a null or empty text has no shingle and links with nothing; fewer than five words are one shingle; repeated rows (also of the same id)
are equal sets; a null id takes part and is its own component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import cut
from .common import SLICE_ROWS, U64, batch_of, give_back, lean, looked_up, mix, ragged, slices, starts, texts, word_hashes
from .links import components, local_roots

_LOW = U64((1 << 48) - 1)
#: Numbers from here on are not rows of a slice (see common.SLICE_ROWS) but tell how many rows a shingle has that travels once.
_HOT_MARK = SLICE_ROWS
_MOST = 0xFFFF - SLICE_ROWS


@dataclass(frozen=True)
class Settings:
    """`percent`: least similarity; `parts`: groups of shingles (0: four for each shuffle partition); `hot`: documents of a chunk from which on a shingle travels once;
    `crowd`: documents of a posting list from which on blocks of `block` documents are compared."""

    words: int = 5
    percent: int = 75
    parts: int = 0
    hot: int = 2
    crowd: int = 64
    block: int = 512
    slice_bytes: int = 2 << 20


def shingle_sets(bodies: list[bytes], memo, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their documents, sorted by hash, then document."""
    split = [t.lower().split() for t in bodies]
    memo.trim()
    ids = looked_up(memo, [w for ws in split for w in ws], U64)
    sizes = np.array([len(w) for w in split], np.int64)
    doc = np.repeat(np.arange(len(split)), sizes)
    if len(ids) >= k:
        acc = ids[:len(ids) - k + 1].copy()
        for j in range(1, k):
            acc = mix(acc * U64(0x9E3779B97F4A7C15) + ids[j:len(ids) - k + 1 + j])
        whole = doc[k - 1:] == doc[:len(ids) - k + 1]
        acc, owner = acc[whole], doc[:len(ids) - k + 1][whole]
    else:
        acc, owner = np.zeros(0, U64), np.zeros(0, np.int64)
    at, short = starts(sizes), np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        one = np.array([int(sizes[d]) for d in short], U64)
        for j in range(k - 1):
            has = sizes[short] > j
            one[has] = mix(one[has] * U64(0xD1342543DE82EF95) + ids[at[short[has]] + j])
        acc, owner = np.concatenate([acc, one]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        acc, owner = acc[order], owner[order]
    order = np.argsort(acc, kind="stable")
    acc, owner = acc[order], owner[order]
    first = np.ones(len(acc), bool)
    first[1:] = (acc[1:] != acc[:-1]) | (owner[1:] != owner[:-1])
    return acc[first], owner[first]


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.reshape(-1).view("<u8")


def _runs(x: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the length at the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])), [len(x)]]) if len(x) else np.zeros(1, np.int64)


_BLOCKS = "part int, chunk long, ids array<long>, a binary, b binary, c binary"
_KINDS = [("part", pa.int32()), ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]


def _read(docs: DataFrame, parts: int, s: Settings) -> DataFrame:
    """Chunks dealt to parts: (part, chunk, -, shingles, documents, -), and for part < 0 the chunk itself: ids, set sizes, shingles that travel once and their documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, memo = pa.schema(_KINDS), word_hashes()
        chunk = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in batches:
            for piece in slices(batch, most=s.slice_bytes):
                h, d = shingle_sets(texts(piece.column("text")), memo, s.words)
                part = ((h >> U64(32)) * U64(parts) >> U64(32)).astype(np.uint16)
                n = np.bincount(d, minlength=piece.num_rows).astype("<i4")
                at = _runs(h)
                many = np.repeat(np.diff(at) > s.hot, np.diff(at))
                hot_at = at[:-1][np.diff(at) > s.hot]
                # what travels: single entries by document, then one entry for each shingle of many documents
                tp = np.concatenate([part[~many], part[hot_at]])
                tt = np.concatenate([h[~many], h[hot_at]])
                td = np.concatenate([d[~many], _HOT_MARK + np.minimum(np.diff(at)[np.diff(at) > s.hot], _MOST)]).astype("<u2")
                order = np.argsort(td, kind="stable")
                order = order[np.argsort(tp[order], kind="stable")]
                tp, tt, td = tp[order], tt[order] & _LOW, td[order]
                cuts = _runs(tp)
                rows = [(int(tp[i]), chunk, None, _six(tt[i:j]), td[i:j].tobytes(), None) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                sizes = np.diff(at)[np.diff(at) > s.hot].astype("<i4")
                full = (part[hot_at].astype(U64) << U64(48)) | (h[hot_at] & _LOW)
                own = full.astype("<u8").tobytes() + sizes.tobytes() if len(full) else b""
                rows.append((-1 - chunk % parts, chunk, piece.column("doc_id").to_pylist(), n.tobytes(), own, d[many].astype("<u2").tobytes()))
                yield batch_of(schema, *zip(*rows, strict=True))
                chunk += 1
        give_back()

    return docs.mapInArrow(run, _BLOCKS)


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per chunk, the shingles of this part that two or more documents have, with the number of documents."""
    if pdf["part"].iloc[0] < 0:
        return pdf
    toks = [_from_six(x) for x in pdf["a"]]
    sizes = np.array([len(t) for t in toks])
    tok, doc = np.concatenate(toks), np.frombuffer(b"".join(pdf["b"]), "<u2")
    row = np.repeat(np.arange(len(toks)), sizes)
    order = np.argsort(tok, kind="stable")
    at = _runs(tok[order])
    weight = np.where(doc > _HOT_MARK, doc.astype(np.int64) - _HOT_MARK, 1)[order]
    df = np.add.reduceat(weight, at[:-1]) if len(order) else np.zeros(0, np.int64)
    each = np.empty(len(tok), np.int64)
    each[order] = np.repeat(df, np.diff(at))
    keep = each >= 2
    at = np.searchsorted(row[keep], np.arange(len(toks) + 1))
    tok, doc, each = tok[keep], doc[keep], np.minimum(each[keep], (1 << 31) - 1).astype("<i4")
    return pd.DataFrame({"part": pdf["part"], "chunk": pdf["chunk"], "ids": None, "a": [_six(tok[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)],
                         "b": [doc[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], "c": [each[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]})


def _gather(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Documents of a chunk: id, n, and where enough are shared the shared shingles by (frequency, hash)."""
        own = pdf[pdf["part"] < 0].iloc[0]
        n = np.frombuffer(own["a"], "<i4").astype(np.int64)
        some = pdf[(pdf["part"] >= 0) & (pdf["a"].str.len() > 0)]
        tok = [(_from_six(a) | (U64(p) << U64(48))) for p, a in zip(some["part"], some["a"], strict=True)]
        tok = np.concatenate([np.zeros(0, U64), *tok])
        doc = np.frombuffer(b"".join(some["b"]), "<u2").astype(np.int64)
        df = np.frombuffer(b"".join(some["c"]), "<i4").astype(np.int64)
        k = len(own["b"]) // 12
        if k:
            hot, sizes = np.frombuffer(own["b"], "<u8", k), np.frombuffer(own["b"], "<i4", k, 8 * k).astype(np.int64)
            order = np.argsort(hot)
            mark = doc > _HOT_MARK
            slot = order[np.searchsorted(hot[order], tok[mark])]
            members = ragged(np.frombuffer(own["c"], "<u2").astype(np.int64), starts(sizes)[:-1][slot], sizes[slot])
            tok = np.concatenate([tok[~mark], np.repeat(tok[mark], sizes[slot])])
            df = np.concatenate([df[~mark], np.repeat(df[mark], sizes[slot])])
            doc = np.concatenate([doc[~mark], members])
        shared = np.bincount(doc, minlength=len(n))
        need = -(-percent * n // 100)
        alive = (n > 0) & (shared >= need)
        keep = alive[doc]
        tok, doc, df = tok[keep], doc[keep], df[keep]
        order = np.lexsort((tok, df, doc))
        tok, df = tok[order].view(np.int64), np.log2(df[order]).astype(np.int8)
        at = starts(np.where(alive, shared, 0))
        ids = own["ids"]
        return pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "n": n.astype(np.int64), "toks": [tok[i:j] if a else None for i, j, a in zip(at[:-1], at[1:], alive, strict=True)],
                             "dfs": [df[i:j] if a else None for i, j, a in zip(at[:-1], at[1:], alive, strict=True)]})
    return run


def _prefix(n: int, unshared: int, percent: int) -> int:
    """Shared shingles in the prefix; the unshared ones come first under both orders."""
    return max(0, n - -(-percent * n // 100) + 1 - unshared)


def _second_order(toks: np.ndarray, dfs: np.ndarray) -> np.ndarray:
    return np.lexsort((mix(toks.view(U64) + U64(0x5851F42D4C957F2D)), dfs))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that link."""
    one = sets.select(F.col("rep").alias("v"), F.col("n").alias("nv"), F.col("toks").alias("tv"), F.col("dfs").alias("fv"))
    two = sets.select(F.col("rep").alias("u"), F.col("n").alias("nu"), F.col("toks").alias("tu"), F.col("dfs").alias("fu"))
    size = F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent
    rows = pairs.join(one, "v").join(two, "u").filter(size).select("u", "v", "nu", "nv", "tu", "fu", "tv", "fv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        for batch in batches:
            c = {n: batch.column(n) for n in batch.schema.names}
            flat = {n: (c[n].flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.asarray(c[n].value_lengths()))])) for n in ("tu", "fu", "tv", "fv")}
            nu, nv = c["nu"].to_numpy(), c["nv"].to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                tu, fu, tv, fv = (flat[n][0][flat[n][1][i]:flat[n][1][i + 1]] for n in ("tu", "fu", "tv", "fv"))
                pu, pv = _prefix(int(nu[i]), int(nu[i]) - len(tu), percent), _prefix(int(nv[i]), int(nv[i]) - len(tv), percent)
                if not len(np.intersect1d(tu[:pu], tv[:pv], assume_unique=True)):
                    continue
                if not len(np.intersect1d(tu[_second_order(tu, fu)[:pu]], tv[_second_order(tv, fv)[:pv]], assume_unique=True)):
                    continue
                both = len(np.intersect1d(tu, tv, assume_unique=True))
                keep[i] = 100 * both >= percent * (nu[i] + nv[i] - both)
            yield pa.RecordBatch.from_arrays([c["u"], c["v"]], schema=schema).filter(pa.array(keep))

    return rows.mapInArrow(run, "u long, v long")


def _common(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sets."""
    ta, tb = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(ta, tb)
    out = np.zeros((len(a), len(b)), np.float32)
    sides = []
    for sets, flat in ((a, ta), (b, tb)):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        col = np.searchsorted(shared, flat)
        hit = (col < len(shared)) & (shared[np.minimum(col, len(shared) - 1)] == flat) if len(shared) else np.zeros(len(flat), bool)
        order = np.argsort(col[hit], kind="stable")
        sides.append((row[hit][order], col[hit][order], len(sets)))
    for k in range(0, len(shared), width):
        dense = []
        for row, col, size in sides:
            i, j = np.searchsorted(col, [k, k + width])
            m = np.zeros((size, width), np.float32)
            m[row[i:j], col[i:j] - k] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _compare(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """A forest of the links between the left and the right documents of a pair of blocks."""
        left, right = pdf[pdf["left"]], pdf[~pdf["left"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"u": [], "v": []}).astype("int64")
        sides = []
        for side in (left, right):
            toks, dfs, n = [np.asarray(t) for t in side["toks"]], [np.asarray(f) for f in side["dfs"]], side["n"].to_numpy()
            p = [_prefix(int(k), int(k) - len(t), percent) for k, t in zip(n, toks, strict=True)]
            sides.append((toks, [t[:k] for t, k in zip(toks, p, strict=True)], [t[_second_order(t, f)[:k]] for t, f, k in zip(toks, dfs, p, strict=True)], n))
        (ta, pa_, qa, na), (tb, pb, qb, nb) = sides
        may = (_common(pa_, pb) > 0) & (_common(qa, qb) > 0)
        both = _common(ta, tb)
        i, j = np.nonzero(may & (100 * both >= percent * (na[:, None] + nb[None] - both)))
        ids, place = np.unique(np.concatenate([left["rep"], right["rep"]]), return_inverse=True)
        root = local_roots(len(ids), place[:len(left)][i], place[len(left):][j])
        moved = root != np.arange(len(ids))
        return pd.DataFrame({"u": ids[moved], "v": ids[root[moved]]})
    return run


def shingle_table(docs: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, toks (shared shingles, rarest first), dfs (log2 of their frequencies) of every row; written once."""
    parts = s.parts or min(65_000, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = _read(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), parts, s)
    answers = blocks.groupBy("part").applyInPandas(_answer, _BLOCKS)
    return cut(answers.groupBy("chunk").applyInPandas(_gather(s.percent), "doc_id long, n long, toks array<long>, dfs array<tinyint>"), "shingles")


def link_forest(sets: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Edges (u, v) that connect exactly the classes that links connect; sets: rep, n, toks, dfs."""
    n, shared = F.col("n"), F.size("toks")
    length = F.greatest(F.lit(0), n - F.ceil(n * s.percent / F.lit(100)) + 1 - (n - shared)).cast("int")
    postings = cut(sets.select("rep", "n", (1 - shared / n).alias("own"), F.explode(F.slice("toks", F.lit(1), length)).alias("tok")), "postings")
    pivots = postings.groupBy("tok").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("own", "rep")).alias("p")).filter("docs > 1").select("tok", "docs", F.col("p.rep").alias("u"))
    near = cut(postings.join(pivots, "tok").filter("u <> rep").groupBy("u", F.col("rep").alias("v")).agg(F.max("docs").alias("docs")), "stars")
    first = cut(_verify(near.select("u", "v"), sets, s.percent), "links")
    crowds = cut(components(near.filter(F.col("docs") > s.crowd)), "crowds")
    linked = cut(components(first), "linked")
    # pairs of different components from small posting lists
    placed = postings.join(pivots.select("tok", "docs"), "tok").join(linked, F.col("rep") == linked["node"], "left").select("tok", "docs", "rep", "n", F.coalesce("root", "rep").alias("part"))
    small = placed.filter(F.col("docs") <= s.crowd)
    other = small.select("tok", F.col("rep").alias("v"), F.col("n").alias("nv"), F.col("part").alias("pv"))
    pairs = (small.withColumnRenamed("rep", "u").join(other, "tok").filter("u < v and part <> pv")
             .filter(F.least("n", "nv") * 100 >= F.greatest("n", "nv") * s.percent).select("u", "v").distinct())
    second = _verify(cut(pairs, "pairs"), sets, s.percent)  # its measured size chooses the join: sets travel only for many pairs
    # blocks: documents outside the largest component of a crowd against all of it
    member = cut(crowds.select(F.col("node").alias("rep"), F.col("root").alias("crowd")).join(linked, F.col("rep") == linked["node"], "left").select("rep", "crowd", F.coalesce("root", "rep").alias("part")), "members")
    sizes = member.groupBy("crowd", "part").agg(F.count(F.lit(1)).alias("k"))
    crowd = (sizes.groupBy("crowd").agg(F.count(F.lit(1)).alias("parts"), F.sum("k").alias("all"), F.max(F.struct("k", "part")).alias("main")).filter("parts > 1")
             .select("crowd", F.col("main.part").alias("main"), F.ceil(F.col("all") / s.block).cast("int").alias("nb"), F.ceil((F.col("all") - F.col("main.k")) / s.block).cast("int").alias("nm")))
    rows = member.join(crowd, "crowd").join(sets, "rep")
    block = lambda k: F.pmod(F.xxhash64("rep"), F.col(k)).cast("int")
    kept = ["crowd", "rep", "n", "toks", "dfs"]
    right = rows.select(*kept, F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("a"), block("nb").alias("b"), F.lit(False).alias("left"))
    left = rows.filter("part <> main").select(*kept, block("nm").alias("a"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"), F.lit(True).alias("left"))
    third = left.unionByName(right).groupBy("crowd", "a", "b").applyInPandas(_compare(s.percent), "u long, v long")
    return first.unionByName(second).unionByName(third)


def near_duplicates(docs: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of `docs`."""
    with lean(docs.sparkSession):
        return _near_duplicates(docs, s, key, text)


def _near_duplicates(docs: DataFrame, s: Settings, key: str, text: str) -> DataFrame:
    table = shingle_table(docs, s, key, text)
    alive = table.filter("toks is not null and doc_id is not null")
    # equal sets: no unshared shingle, and the same shared ones
    same = [F.xxhash64("n", "toks").alias("h1"), F.xxhash64(F.lit(29), "n", "toks").alias("h2")]
    own = F.when(F.size("toks") < F.col("n"), F.col("doc_id")).alias("own")
    keyed = alive.select("doc_id", "n", "toks", "dfs", *same, own)
    sets = cut(keyed.groupBy("h1", "h2", "own").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("toks").alias("toks"), F.first("dfs").alias("dfs")), "sets")
    roots = components(cut(link_forest(sets.select("rep", "n", "toks", "dfs"), s), "forest"))
    classes = sets.join(roots, F.col("rep") == roots["node"], "left").select("h1", "h2", "own", F.coalesce("root", "rep").alias("component_id"))
    hashed = table.select("doc_id", "n", F.when(F.col("toks").isNotNull(), same[0]).alias("h1"), F.when(F.col("toks").isNotNull(), same[1]).alias("h2"), own)
    match = (hashed["h1"] == classes["h1"]) & (hashed["h2"] == classes["h2"]) & hashed["own"].eqNullSafe(classes["own"])
    return hashed.join(classes, match, "left").select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))

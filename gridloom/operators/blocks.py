"""Grids in square blocks: what one Arrow pass can do for whole blocks before anything global is needed.

A block is a square of BLOCK x BLOCK cells of one key (a tile, or an object of a tile). Rows are dealt by key and block, sorted, and read in tables of whole
blocks, so the work inside is array code over many blocks at once and memory is bounded by one block beyond `LEAST` rows, whatever the size of a tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256
LEAST = 200_000
# run id = y * 2^31 + x0: its order is the raster-scan order
ROW = 1 << 31


def codes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equal numbers for equal values of any kind, null included."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def ints(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64, copy=False)


def groups(table: pa.Table, names: list[str]) -> np.ndarray:
    """Number of each row's group, from 0, where rows of equal `names` follow one another."""
    new = np.zeros(table.num_rows, bool)
    for n in names:
        c = codes(table.column(n))
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str], least: int = LEAST) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted rows, of at least `least` rows but the last, with the rows' group numbers."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= least:
            table = pa.Table.from_batches(held)
            number = groups(table, names)
            end = int(np.searchsorted(number, number[-1]))
            if end:
                yield table.slice(0, end), number[:end]
            rest = table.slice(end)
            held, size = rest.combine_chunks().to_batches(), 0 if end else -rest.num_rows  # a group larger than `least` waits for as many rows again
    if held:
        table = pa.Table.from_batches(held)
        yield table, groups(table, names)


def ragged_ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row i and each number of [first[i], last[i])."""
    n = np.maximum(last - first, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n - first, n)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes by edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for at in (root[a], root[b]):
            np.minimum.at(new, at, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def ddl(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in names)


def with_columns(table: pa.Table, names: list[str], **added: np.ndarray) -> Iterator[pa.RecordBatch]:
    out = pa.table([*[table.column(c) for c in names], *[pa.array(v) for v in added.values()]], names=[*names, *added])
    yield from out.combine_chunks().to_batches()


# labelling -----------------------------------------------------------------------------------------------------------------------------------------------
def labelled(spans: DataFrame, conn: int, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Runs (y, x0, x1) cut at block borders (p0, p1), with `local`: the id of the first piece of its component inside the block.

    `conn` 1 links by sides, 2 also by corners.
    """
    slack, side = int(conn > 1), block + 2
    names = [*keys, "_by", "_bx"]
    # x0 and x1 follow the pieces, so that a run can be had back from the piece that begins it
    cut_up = spans.select(*keys, F.col("y").cast("bigint").alias("y"), F.col("x0").cast("bigint").alias("x0"), F.col("x1").cast("bigint").alias("x1"),
                          F.explode(F.sequence(F.expr(f"x0 div {block}"), F.expr(f"x1 div {block}"))).alias("_bx"))
    pieces = cut_up.select(*keys, "y", F.greatest("x0", F.col("_bx") * block).alias("p0"), F.least("x1", (F.col("_bx") + 1) * block - 1).alias("p1"), "x0", "x1",
                           F.expr(f"y div {block}").alias("_by"), "_bx")
    kept = [*keys, "y", "p0", "p1", "x0", "x1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole_groups(batches, names):
            y, p0, p1 = (ints(table, c) for c in ("y", "p0", "p1"))
            row = (number * side + y % block) * side
            first, last = row + p0 % block, row + p1 % block
            # rows of a block are apart by more than the slack, and so are blocks; the next row's pieces that touch follow one another
            a, b = ragged_ranges(np.searchsorted(last, first + side - slack), np.searchsorted(first, last + side + slack, side="right"))
            yield from with_columns(table, kept, local=(y * ROW + p0)[local_roots(len(y), a, b)])

    return (pieces.repartition(*names).sortWithinPartitions(*names, "y", "p0").mapInArrow(run, ddl(pieces, kept) + ", local bigint"))


def border_links(pieces: DataFrame, conn: int, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Pairs (u, v) of local components that touch across a border of blocks; only pieces on borders are shuffled, by border and block."""
    slack = int(conn > 1)
    names = [*keys, "kind", "line", "slot"]

    def place(kind: int, line: str, slot: str, upper: bool, lo: str, hi: str):
        return F.struct(F.lit(kind).alias("kind"), F.expr(line).alias("line"), F.expr(slot).alias("slot"), F.lit(upper).alias("upper"), F.expr(lo).alias("lo"), F.expr(hi).alias("hi"))

    # a piece above a border is sent to each block below that it can touch (its own and both neighbours at most), so a pair meets at the block of the lower piece
    below = [place(0, f"(y + 1) div {block}", f"({x}) div {block}", True, "p0", "p1") for x in (f"p0 - {slack}", "p0", f"p1 + {slack}")]
    beside = [place(1, f"(p1 + 1) div {block}", f"(y + {dy}) div {block}", True, "y", "y") for dy in (-slack, slack)]
    none = F.array().cast("array<struct<kind:int,line:bigint,slot:bigint,upper:boolean,lo:bigint,hi:bigint>>")
    spread = F.array_distinct(F.concat(
        F.when(F.expr(f"y % {block} = {block - 1}"), F.array(*below)).otherwise(none),
        F.when(F.expr(f"y % {block} = 0"), F.array(place(0, f"y div {block}", f"p0 div {block}", False, "p0", "p1"))).otherwise(none),
        F.when(F.expr(f"p1 % {block} = {block - 1}"), F.array(*beside)).otherwise(none),
        F.when(F.expr(f"p0 % {block} = 0"), F.array(place(1, f"p0 div {block}", f"y div {block}", False, "y", "y"))).otherwise(none)))
    sent = pieces.withColumn("_s", F.explode(spread)).select(*keys, "local", "_s.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole_groups(batches, names):
            upper, local, lo, hi = table.column("upper").to_numpy(), ints(table, "local"), ints(table, "lo"), ints(table, "hi")
            side = int(hi.max()) + 4
            top, low = np.flatnonzero(upper), np.flatnonzero(~upper)
            first, last = number * side + lo + 1, number * side + hi + 1
            a, b = ragged_ranges(np.searchsorted(last[low], first[top] - slack), np.searchsorted(first[low], last[top] + slack, side="right"))
            u, v = top[a], low[b]
            pair = np.unique(np.stack([np.maximum(local[u], local[v]), np.minimum(local[u], local[v]), number[u]]), axis=1, return_index=True)[1]
            at = u[pair]
            yield from with_columns(table.select(keys).take(pa.array(at)), keys, u=np.maximum(local[u], local[v])[pair], v=np.minimum(local[u], local[v])[pair])

    return sent.repartition(*names).sortWithinPartitions(*names, "upper", "lo").mapInArrow(run, ddl(pieces, keys) + (", " if keys else "") + "u bigint, v bigint")


# filling -------------------------------------------------------------------------------------------------------------------------------------------------
#: Cells that are laid out at a time, those of unequal blocks' padding included.
_LAID = 1 << 20
#: Cells of a line that travel as the bits of one number.
WORD = 64


def _median(a: np.ndarray, h: np.ndarray, w: np.ndarray, ends: list[np.ndarray]) -> np.ndarray:
    """3x3 binary medians of blocks with a halo of one cell; beyond the ends of a tile its edge repeats."""
    top, bottom, left, right = (np.flatnonzero(e) for e in ends)
    a[top, 0] = a[top, 1]
    a[bottom, h[bottom] + 1] = a[bottom, h[bottom]]
    a[left, :, 0] = a[left, :, 1]
    a[right, :, w[right] + 1] = a[right, :, w[right]]
    n = a.view(np.uint8)
    n = n[:, :-2] + n[:, 1:-1] + n[:, 2:]
    return n[:, :, :-2] + n[:, :, 1:-1] + n[:, :, 2:] >= 5


def _gaps(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (block, y, x0, x1) of unset cells and the first run of their side-connected region inside the block."""
    blocks, high, wide = gap.shape
    pad = np.zeros((blocks, high + 1, wide + 2), np.int8)
    pad[:, :high, 1:-1] = gap
    step = np.diff(pad.reshape(-1))
    side = wide + 2
    first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1
    # an empty row parts blocks, so the next line's runs that touch follow one another
    a, b = ragged_ranges(np.searchsorted(last, first + side), np.searchsorted(first, last + side, side="right"))
    line = first // side
    return line // (high + 1), line % (high + 1), first % side, last % side, local_roots(len(first), a, b)


def cleaned_blocks(mask: DataFrame, boxes: DataFrame, buffer: DataFrame | None, median: bool, fill: bool, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Cells (y, x, `filled`) of the mask after a 3x3 median, the cut to the buffer, and the filling of holes and a second cut, each step if asked for.

    `boxes` (y0, y1, x0, x1) are the tiles' ends; cells beyond have no place. All layers meet once, by block, as words of up to 64 cells of a line; words beside a
    block's border are sent to the next block too.
    Unset regions that reach neither a tile's end nor another block are holes. Rows with a `local` are the runs (y, x to x1) of regions that reach another
    block, with the id of the region inside its block and `edge` set if it reaches a tile's end; a region known to be open has only its runs on borders.
    """
    names, clipped = [*keys, "_by", "_bx"], buffer is not None
    last = (block - 1) // WORD

    def layer(df: DataFrame, kind: int, *columns: str):
        return df.select(*keys, F.col("_by").cast("int"), F.col("_bx").cast("int"), F.lit(kind).cast("tinyint").alias("kind"),
                         *[F.expr(c).cast("int").alias(n) for c, n in zip(columns, ("y", "x", "y1", "x1"), strict=True)], F.expr("bits" if kind else "0L").alias("bits"))

    def lines(df: DataFrame, halo: int) -> DataFrame:
        """Words of cells of a line, with copies for the blocks beside them."""
        words = (df.filter("y >= 0 and x >= 0").groupBy(*keys, "y", F.expr(f"x div {block}").alias("_bx"), F.expr(f"x % {block} div {WORD}").alias("_w"))
                 .agg(F.expr(f"bit_or(shiftleft(1L, cast(x % {block} % {WORD} as int)))").alias("bits"))
                 .select("*", F.expr(f"y div {block}").alias("_by"), F.expr(f"_bx * {block} + _w * {WORD}").alias("x")))
        if not halo:
            return words
        near = f"sequence(greatest(y - {halo}, 0) div {block}, (y + {halo}) div {block})"
        beside = f"sequence(if(_w = 0 and _bx > 0, _bx - 1, _bx), if(_w = {last}, _bx + 1, _bx))"
        return words.withColumn("_by", F.explode(F.expr(near))).withColumn("_bx", F.explode(F.expr(beside)))

    ends = boxes.withColumn("_by", F.explode(F.expr(f"sequence(y0 div {block}, y1 div {block})"))).withColumn("_bx", F.explode(F.expr(f"sequence(x0 div {block}, x1 div {block})")))
    stacked = layer(ends, 0, "y0", "x0", "y1", "x1").unionByName(layer(lines(mask, int(median)), 1, "y", "x", "null", "null"))
    if clipped:
        stacked = stacked.unionByName(layer(lines(buffer, 0), 2, "y", "x", "null", "null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole_groups(batches, names, LEAST // WORD):
            head = np.flatnonzero(table.column("kind").to_numpy() == 0)
            head = head[np.unique(number[head], return_index=True)[1]]
            of = np.full(int(number[-1]) + 1, -1)  # blocks outside every tile have no box
            of[number[head]] = np.arange(len(head))
            at = table.take(pa.array(head))
            y0, x0, y1, x1, by, bx = (ints(at, c) for c in ("y", "x", "y1", "x1", "_by", "_bx"))
            top, left = np.maximum(y0, by * block), np.maximum(x0, bx * block)
            h, w = np.minimum(y1 + 1, (by + 1) * block) - top, np.minimum(x1 + 1, (bx + 1) * block) - left
            ends = [top == y0, top + h == y1 + 1, left == x0, left + w == x1 + 1]
            word = np.flatnonzero((table.column("kind").to_numpy() > 0) & (of[number] >= 0))
            row, bit = np.nonzero(np.unpackbits(ints(table, "bits")[word].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            word = word[row]
            g, kind = of[number[word]], table.column("kind").to_numpy()[word]
            y, x = ints(table, "y")[word], ints(table, "x")[word] + bit
            inside = (y >= np.maximum(y0, top - 1)[g]) & (y <= np.minimum(y1, top + h)[g]) & (x >= np.maximum(x0, left - 1)[g]) & (x <= np.minimum(x1, left + w)[g])
            g, kind, y, x = (c[inside] for c in (g, kind, y, x))
            y, x = y - top[g] + 1, x - left[g] + 1
            low = 0
            while low < len(head):
                # as many blocks as their common frame leaves room for
                ahead = slice(low, low + _LAID // 64)
                area = (np.maximum.accumulate(h[ahead]) + 2) * (np.maximum.accumulate(w[ahead]) + 2) * np.arange(1, len(h[ahead]) + 1)
                high = low + max(1, int(np.searchsorted(area, _LAID, side="right")))
                a, b = np.searchsorted(g, [low, high])
                some = slice(low, high)
                frame = np.zeros((2, high - low, int(h[some].max()) + 2, int(w[some].max()) + 2), bool)
                frame[kind[a:b] - 1, g[a:b] - low, y[a:b], x[a:b]] = True
                tall, wide = h[some, None, None], w[some, None, None]
                room = (np.arange(frame.shape[2] - 2)[None, :, None] < tall) & (np.arange(frame.shape[3] - 2)[None, None, :] < wide)
                seen = _median(frame[0], h[some], w[some], [e[some] for e in ends]) if median else frame[0, :, 1:-1, 1:-1]
                clip = frame[1, :, 1:-1, 1:-1] if clipped else True
                seen = seen & room & clip
                at_cell = [(np.nonzero(seen), False)]
                if fill:
                    n, r, p, q, root = _gaps(room & ~seen)
                    i = n + low
                    edge = (ends[0][i] & (r == 0)) | (ends[1][i] & (r == h[i] - 1)) | (ends[2][i] & (p == 0)) | (ends[3][i] & (q == w[i] - 1))
                    onward = (~ends[0][i] & (r == 0)) | (~ends[1][i] & (r == h[i] - 1)) | (~ends[2][i] & (p == 0)) | (~ends[3][i] & (q == w[i] - 1))
                    is_open, reaches = (np.bincount(root, c, len(root))[root] > 0 for c in (edge, onward))
                    hole = np.flatnonzero(~is_open & ~reaches)
                    row, col = ragged_ranges(p[hole], q[hole] + 1)
                    k = hole[row]
                    free = frame[1, n[k], r[k] + 1, col + 1] if clipped else np.ones(len(k), bool)
                    at_cell.append(((n[k][free], r[k][free], col[free]), True))
                    wait = np.flatnonzero(reaches & (~is_open | onward))
                    if len(wait):
                        i = i[wait]
                        local = ((top[n + low] + r) * ROW + left[n + low] + p)[root[wait]]
                        yield from with_columns(at.select(keys).take(pa.array(i)), keys, y=(top[i] + r[wait]).astype(np.int32), x=(left[i] + p[wait]).astype(np.int32),
                                                filled=np.ones(len(i), bool), x1=(left[i] + q[wait]).astype(np.int32), local=local, edge=is_open[wait])
                for (n, r, c), filled in at_cell:
                    if len(n):
                        i = n + low
                        out = pa.table([*at.select(keys).take(pa.array(i)).columns, pa.array((top[i] + r).astype(np.int32)), pa.array((left[i] + c).astype(np.int32)), pa.array(np.full(len(i), filled)),
                                        pa.nulls(len(i), pa.int32()), pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.bool_())], names=[*keys, "y", "x", "filled", "x1", "local", "edge"])
                        yield from out.combine_chunks().to_batches()
                low = high

    schema = ddl(stacked, keys) + (", " if keys else "") + "y int, x int, filled boolean, x1 int, local bigint, edge boolean"
    return stacked.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, schema)


# thinning ------------------------------------------------------------------------------------------------------------------------------------------------
HALO = 32
# fixed values: the ring of neighbours N NE E SE S SW W NW as (dy, dx)
_RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def neighbours(number: np.ndarray, y: np.ndarray, x: np.ndarray, side: int) -> list[np.ndarray]:
    """Index of each cell's eight neighbours in its group (the number of cells where there is none); cells are sorted by group, y, x."""
    place = (number * side + y) * side + x
    out = []
    for dy, dx in _RING:
        wanted = place + dy * side + dx
        at = np.searchsorted(place, wanted)
        at[at == len(place)] = 0
        out.append(np.where(place[at] == wanted, at, len(place)))
    return out


def _thinned(near: list[np.ndarray], n: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Which cells stay after so many rounds, and which went in the last one."""
    alive = np.ones(n + 1, bool)
    alive[n] = False
    before: list[np.ndarray] = []  # what went in each subpass so far
    last = np.zeros(n, bool)
    for step in range(2 * rounds):
        if step < 2:
            active = np.arange(n)
        else:
            # a cell's fate can change only beside a cell that went since the same rule was last tried
            mark = np.zeros(n + 1, bool)
            for p in near:
                for gone in before[-2:]:
                    mark[p[gone]] = True
            active = np.flatnonzero(mark[:n] & alive[:n])
            if not len(active):
                return alive[:n], last & False
        v = [alive[p[active]] for p in near]
        count = np.sum(v, axis=0, dtype=np.int8)
        turns = np.sum([~a & b for a, b in zip(v, v[1:] + v[:1], strict=True)], axis=0, dtype=np.int8)
        north, east, south, west = v[0], v[2], v[4], v[6]
        rule = ~(north & east & west) & ~(north & south & west) if step % 2 else ~(north & east & south) & ~(east & south & west)
        gone = active[alive[active] & (count >= 2) & (count <= 6) & (turns == 1) & rule]
        alive[gone] = False
        before.append(gone)
    last[np.concatenate(before[-2:])] = True
    return alive[:n], last


def thinning_step(cells: DataFrame, keys: list[str], block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """Cells after halo / 2 rounds of two-subpass thinning (Zhang and Suen, 1984); `moving` is set where the last of these rounds still changed the block.

    A round looks one cell far twice, so a block that knows `halo` cells around it can do halo / 2 rounds alone; one shuffle serves them all.
    """
    names, rounds = ["_by", "_bx", *keys], halo // 2
    sends = F.expr(f"""flatten(transform(sequence((y - {halo}) div {block} - IF(y < {halo}, 1, 0), (y + {halo}) div {block}), b ->
        transform(sequence((x - {halo}) div {block} - IF(x < {halo}, 1, 0), (x + {halo}) div {block}), c -> struct(b AS _by, c AS _bx))))""")
    sent = cells.select(*keys, F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x")).withColumn("_b", F.explode(sends)).select(*keys, "y", "x", "_b._by", "_b._bx")
    kept = [*keys, "y", "x", "_by", "_bx"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole_groups(batches, names):
            y, x, by, bx = (ints(table, c) for c in ("y", "x", "_by", "_bx"))
            side = block + 2 * halo + 4
            ry, rx = y - by * block + halo + 1, x - bx * block + halo + 1
            alive, last = _thinned(neighbours(number, ry, rx, side), len(y), rounds)
            own = (y // block == by) & (x // block == bx)
            moving = np.bincount(number[last & own], minlength=number[-1] + 1)[number] > 0
            stay = np.flatnonzero(own & alive)
            yield from with_columns(table.take(pa.array(stay)), kept, moving=moving[stay])

    return sent.repartition(*names).sortWithinPartitions(*names, "y", "x").mapInArrow(run, ddl(sent, kept) + ", moving boolean")


# distance ------------------------------------------------------------------------------------------------------------------------------------------------
def envelope(g: np.ndarray, left: bool, right: bool) -> np.ndarray:
    """min over q of (x - q)^2 + g[q]^2 for the cells x of a row run; `left` and `right` tell of unset cells beyond its ends.

    The lower envelope of parabolas (Felzenszwalb and Huttenlocher, 2012), by whole-number comparisons. A negative g has no parabola.
    """
    at = [(-1, 0)] if left else []
    at += [(q, int(v) * int(v)) for q, v in enumerate(g.tolist()) if v >= 0]
    if right:
        at.append((len(g), 0))
    hull: list[tuple[int, int]] = []
    begin: list[int] = []  # first x at which a parabola is the least
    for q, h in at:
        while hull:
            p, k = hull[-1]
            # q is below p from x on where 2x (q - p) >= h + q^2 - k - p^2
            x = -((k + p * p - h - q * q) // (2 * (q - p)))
            if x > begin[-1]:
                break
            hull.pop()
            begin.pop()
        hull.append((q, h))
        begin.append(x if len(hull) > 1 else -2)
    out = np.full(len(g), -1, np.int64)
    if not hull:
        return out
    for (q, h), a, b in zip(hull, begin, [*begin[1:], len(g)], strict=True):
        a, b = max(a, 0), min(b, len(g))
        if a < b:
            x = np.arange(a, b)
            out[a:b] = (x - q) ** 2 + h
    return out


def row_distances(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Squared distances along rows: `rows` are cells with `run` (its first x in the row), `g` (column distance, -1 for none), `open_left`, `open_right`.

    One row run of an object is one group; what lies beyond its ends is farther than the ends themselves, so groups are apart. The rows of a group must be in
    one partition already.
    """
    order = [*keys, "y", "run"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole_groups(batches, order):
            g, left, right = ints(table, "g"), table.column("open_left").to_numpy(), table.column("open_right").to_numpy()
            ends = np.append(np.flatnonzero(np.diff(number)) + 1, len(number))
            out, a = np.empty(len(g), np.int64), 0
            for b in ends.tolist():
                out[a:b] = envelope(g[a:b], left[a], right[a])
                a = b
            yield from with_columns(table, names, d2=out)

    return rows.sortWithinPartitions(*order, "x").mapInArrow(run, ddl(rows, names) + ", d2 bigint")

"""Masks to polygons as ring vertices, traced in blocks and joined by list ranking instead of a walk in one task.

Each exposed cell side is a directed edge with the object on its right. Its successor and whether it begins at a corner follow from the neighbours of its cell, so a
block of cells that knows one cell around it traces its rings alone, in array code. A ring that crosses blocks leaves a chain of sides in each; only chains are
ranked across blocks, by pointer doubling in about log2(chains of a ring) joins, so a ring of any length is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordering import ordinal
from ..plans.scratch import StepTable, cut
from .blocks import BLOCK, ROW, ddl, ints, neighbours, ragged_ranges, whole_groups
from .components import rooted_runs
from .tiling import TILE

# directions: 0 east on the top side, 1 south on the right side, 2 west on the bottom side, 3 north on the left side; places in the ring N NE E SE S SW W NW of the
# neighbour beyond each side, ahead along it, diagonally ahead on the outer side, behind, and diagonally behind
_BEYOND, _AHEAD, _DIAGONAL, _BEHIND, _BACK = (0, 2, 4, 6), (2, 4, 6, 0), (1, 3, 5, 7), (6, 0, 2, 4), (7, 1, 3, 5)
# what a block tells: corners of whole rings, corners of chains, chains
_CLOSED, _OPEN, _CHAIN = 0, 1, 2


def _reached(nxt: np.ndarray, low: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest `low`, and whether any of `ends`, over all successors of each place; the last place of a chain is its own successor."""
    while True:
        less, more = np.minimum(low, low[nxt]), ends | ends[nxt]
        if (less == low).all() and (more == ends).all():
            return low, ends
        low, ends, nxt = less, more, nxt[nxt]


def _ranked(nxt: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps to the last place of each chain, and that place."""
    nxt, steps = np.where(last, np.arange(len(nxt)), nxt), np.where(last, 0, 1)
    while not last[nxt].all():
        steps, nxt = steps + steps[nxt], nxt[nxt]
    return steps, nxt


def _block_rings(kept: list[str], names: list[str], block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole_groups(batches, names):
            left_end, right_end = ints(table, "_bx") * block - 1, ints(table, "_bx") * block + block
            source, x = ragged_ranges(np.maximum(ints(table, "x0"), left_end), np.minimum(ints(table, "x1"), right_end) + 1)
            y, by, bx = (ints(table, c)[source] for c in ("y", "_by", "_bx"))
            near, n = neighbours(number[source], y - by * block + 2, x - bx * block + 2, block + 6), len(y)
            has = [p < n for p in near]
            own = (y // block == by) & (x // block == bx)
            sides = []
            for d in range(4):
                c = np.flatnonzero(own & ~has[_BEYOND[d]])
                ahead, left = has[_AHEAD[d]][c], (has[_AHEAD[d]] & has[_DIAGONAL[d]])[c]
                to = np.where(left, near[_DIAGONAL[d]][c], np.where(ahead, near[_AHEAD[d]][c], c))
                turned = np.where(left, (d + 3) % 4, np.where(ahead, d, (d + 1) % 4))
                sides.append((c, np.full(len(c), d), to, turned, ~(has[_BEHIND[d]] & ~has[_BACK[d]])[c]))
            cell, side, to, turned, corner = (np.concatenate(v) for v in zip(*sides, strict=True))
            edge, eid = np.arange(len(cell)), (y[cell] * ROW + x[cell]) * 4 + side
            place = np.full(4 * n, -1)
            place[cell * 4 + side] = edge
            leaves = ~own[to]
            nxt = np.where(leaves, edge, place[to * 4 + turned])
            begins = np.ones(len(edge), bool)
            begins[nxt[~leaves]] = False
            low, is_open = _reached(nxt, eid, leaves)
            # a whole ring is cut before its smallest side
            steps, tail = _ranked(nxt, leaves | ~is_open & (eid[nxt] == low))
            first = np.flatnonzero(np.where(is_open, begins, eid == low))
            head = np.empty(len(edge), np.int64)
            head[tail[first]] = first
            head = head[tail]
            seq = steps[head] - steps

            def rows(at: np.ndarray, kind: np.ndarray, **more: np.ndarray) -> Iterator[pa.RecordBatch]:
                columns = {"head": eid[head[at]], "seq": seq[at], "vy": (y[cell] + (side >= 2))[at], "vx": (x[cell] + ((side == 1) | (side == 2)))[at], **{c: np.zeros(len(at), np.int64) for c in ("nxt", "n", "low", "low_at")}, **more}
                taken = table.select(kept).take(pa.array(source[cell[at]]))
                out = pa.table([*taken.columns, pa.array(kind), *[pa.array(v) for v in columns.values()]], names=[*kept, "kind", *columns])
                yield from out.combine_chunks().to_batches()

            at = np.flatnonzero(corner)
            yield from rows(at, np.where(is_open[at], _OPEN, _CLOSED))
            at = np.flatnonzero(begins)
            smallest = np.empty(len(edge), np.int64)
            found = np.flatnonzero(eid == low[head])
            smallest[tail[found]] = found
            end = tail[at]
            yield from rows(at, np.full(len(at), _CHAIN), nxt=((y[to] * ROW + x[to]) * 4 + turned)[end], n=steps[at] + 1, low=low[at], low_at=seq[smallest[end]])

    return run


def _traced(regions: DataFrame, key: list[str], block: int) -> DataFrame:
    """Corners of rings and of chains (head: the first side's id, seq: sides before it), and chains: the side that follows, their number of sides, the smallest one and its place."""
    def span(low: str, high: str) -> Column:
        # a block is also told of the cells next to it
        return F.sequence(F.expr(f"least(floor({low} / {block}), greatest(floor(({low} - 1) / {block}), 0L))"), F.expr(f"floor(({high} + 1) / {block})"))

    names = ["_by", "_bx", *key]
    sent = regions.select(*key, "y", "x0", "x1").withColumn("_by", F.explode(span("y", "y"))).withColumn("_bx", F.explode(span("x0", "x1")))
    schema = ddl(regions, key) + ", kind bigint, " + ", ".join(f"{c} bigint" for c in ("head", "seq", "vy", "vx", "nxt", "n", "low", "low_at"))
    return sent.repartition(*names).sortWithinPartitions(*names, "y", "x0").mapInArrow(_block_rings(key, names, block), schema)


def ring_vertices(regions: DataFrame, key: list[str], block: int = BLOCK) -> DataFrame:
    """Corner points (key, ring, seq, y, x) of every ring of the runs (y, x0, x1); `ring` is its smallest edge id, `seq` counts sides from 0.

    Outer rings run clockwise (y down), holes the other way.
    """
    traced = cut(_traced(regions, key, block), "sides")
    corner = [F.col("vy").cast("int").alias("vy"), F.col("vx").cast("int").alias("vx")]
    whole = traced.filter(F.col("kind") == _CLOSED).select(*key, F.col("head").alias("ring"), "seq", *corner)
    chains = traced.filter(F.col("kind") == _CHAIN).select(*key, "head", "nxt", "n", "low", "low_at")
    if chains.isEmpty():
        return whole
    # smallest edge id over 2^k successors, until stable everywhere
    step = StepTable(chains.select(*key, "head", "nxt", F.col("low").alias("ring")), "ring")
    while True:
        a = step.df
        b = a.select(*key, F.col("head").alias("nxt"), F.col("nxt").alias("_n2"), F.col("ring").alias("_r2"))
        following = StepTable(a.join(b, [*key, "nxt"]).select(
            *key, "head", F.col("_n2").alias("nxt"), F.least("ring", "_r2").alias("ring"), (F.col("_r2") < F.col("ring")).alias("_moved")), "ring")
        step.drop()
        step = following
        if not step.df.filter("_moved").limit(1).count():
            break
    # cut each ring before the chain of its first edge and count the sides to the cut
    linked = cut(chains.join(step.df.select(*key, "head", "ring"), [*key, "head"]), "chains")
    begin = linked.filter("low = ring").select(*key, "ring", F.col("head").alias("_first"), F.col("low_at").alias("_at"))
    linked = cut(linked.join(begin, [*key, "ring"]), "begun")
    step = StepTable(linked.select(*key, "head", F.when(F.col("nxt") != F.col("_first"), F.col("nxt")).alias("nxt"), F.col("n").alias("left")), "rank")
    while step.df.filter("nxt is not null").limit(1).count():
        a = step.df
        b = a.select(*key, F.col("head").alias("nxt"), F.col("nxt").alias("_n2"), F.col("left").alias("_l2"))
        following = StepTable(a.join(b, [*key, "nxt"], "left").select(
            *key, "head", F.col("_n2").alias("nxt"), (F.col("left") + F.coalesce("_l2", F.lit(0))).alias("left")), "rank")
        step.drop()
        step = following
    ranked = linked.select(*key, "head", "ring", "_first", "_at").join(step.df.select(*key, "head", "left"), [*key, "head"])
    size = ranked.filter("head = _first").select(*key, "ring", F.col("left").alias("_all"))
    ranked = ranked.join(size, [*key, "ring"]).select(*key, "head", "ring", "_all", (F.col("_all") - F.col("left") - F.col("_at")).alias("_base"))
    parts = traced.filter(F.col("kind") == _OPEN).join(ranked, [*key, "head"])
    return whole.unionByName(parts.select(*key, "ring", F.pmod(F.col("seq") + F.col("_base"), F.col("_all")).alias("seq"), *corner))


def mask_polygons(mask: DataFrame, tiles: DataFrame, keys: list[str] = TILE, start_id: int = 0, order: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Ring vertices in world coordinates with running polygon ids over (keys, raster order)."""
    rooted = cut(rooted_runs(mask, 1, keys, block), "regions")
    first = rooted.filter(F.col("y").cast("bigint") * F.lit(ROW) + F.col("x0") == F.col("root"))  # a component's root names its first run
    ids = ordinal(first.select(*keys, "root"), [F.col(c) for c in (order or keys)] + [F.col("root")], "geom_id", start_id)
    homes = ids.select(*keys, "root", "geom_id").join(tiles.select(*keys, "left", "top", "px"), keys)
    v = ring_vertices(rooted, [*keys, "root"], block).join(homes, [*keys, "root"])
    # a component's first ring starts at its raster-first cell, the outer one
    outer = F.col("ring") == F.expr("(shiftright(root, 31) * 2147483648 + (root & 2147483647)) * 4")
    return v.select(
        "geom_id", *keys, "ring", outer.alias("is_outer"), "seq",
        (F.col("left") + F.col("vx") * F.col("px")).alias("wx"), (F.col("top") - F.col("vy") * F.col("px")).alias("wy"))


def polygon_areas(vertices: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Net area per polygon from its ring vertices (holes subtract), with the polygon's `keys`; the sort window holds one ring."""
    w = Window.partitionBy("geom_id", "ring").orderBy("seq")
    first = F.first("wx").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("wy").over(w.rowsBetween(Window.unboundedPreceding, 0))
    nx, ny = F.coalesce(F.lead("wx").over(w), first[0]), F.coalesce(F.lead("wy").over(w), first[1])
    part = vertices.withColumn("_a", F.col("wx") * ny - nx * F.col("wy"))
    return part.groupBy("geom_id", *(keys or [])).agg((-F.sum("_a") / 2.0).alias("area"), F.countDistinct("ring").alias("rings"))


def append_ids(polygons: DataFrame, start_id: int, order: list[Column]) -> tuple[DataFrame, int]:
    """Number appended polygons from `start_id`; an empty input leaves the next id unchanged."""
    placed = cut(ordinal(polygons, order, "geom_id", start_id), "appended")
    return placed, start_id + placed.count()

"""Mask refinement: clean-up chain and mean-field smoothing on a bilateral grid.

The fully connected pairwise model is solved by mean-field steps. A Gaussian and a bilateral kernel are evaluated on coarse
grids with cells of one standard deviation (Chen, Paris and Durand, 2007): splat = sum onto grid vertices, blur = 1-2-1
passes along each axis over occupied vertices, slice = read back at the cell. Approximate by design; the invariants are in the tests.

A filter reaches three standard deviations in space and no further. So a block of cells is read with a halo of that reach for each filter it runs, and
as many filters run in one pass as keep the halo within the block; only cells are shuffled, once a pass, and a tile within one block needs one pass.
Kernels too wide for a block go through tables of grid vertices instead (`kernel` is a key; the same sums).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..plans.scratch import StepTable, cut
from .blocks import BLOCK, ddl, whole_groups, with_columns
from .components import cleaned
from .tiling import TILE


@dataclass(frozen=True)
class PairwiseConfig:
    prob_softness: float = 0.05
    trimap_band: int = 0
    pos_w: float = 3.0
    pos_xy_std: float = 3.0
    bilateral_w: float = 5.0
    bilateral_xy_std: float = 50.0
    bilateral_rgb_std: float = 5.0
    steps: int = 5


KERNEL_PARAMS = ["pos_w", "pos_xy_std", "bilateral_w", "bilateral_xy_std", "bilateral_rgb_std"]
_AXES = ["vy", "vx", "vr", "vg", "vb"]


def _taps(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Grid vertices of every cell: four corners in space, nearest bin in colour. Kernel parameters are columns."""
    kernels = [(0, "pos_w", "pos_xy_std", None), (1, "bilateral_w", "bilateral_xy_std", "bilateral_rgb_std")]
    corners = []
    for kernel, weight, s_xy, s_rgb in kernels:
        u, v = F.col("y") / F.col(s_xy), F.col("x") / F.col(s_xy)
        bins = [F.floor(F.col(c) / F.col(s_rgb) + 0.5).cast("int") if s_rgb else F.lit(0) for c in ("r", "g", "b")]
        for dy in (0, 1):
            for dx in (0, 1):
                wy = (u - F.floor(u)) if dy else (1.0 - (u - F.floor(u)))
                wx = (v - F.floor(v)) if dx else (1.0 - (v - F.floor(v)))
                corners.append(F.struct(
                    F.lit(kernel).alias("kernel"), F.col(weight).alias("kw"), (F.floor(u) + dy).cast("int").alias("vy"),
                    (F.floor(v) + dx).cast("int").alias("vx"), bins[0].alias("vr"), bins[1].alias("vg"), bins[2].alias("vb"),
                    (wy * wx).alias("w")))
    return (cells.select(*keys, "y", "x", F.explode(F.array(*corners)).alias("_t"))
            .select(*keys, "y", "x", "_t.*").filter("w > 0 and kw > 0"))


def _blur(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """1-2-1 pass along each axis; results are kept only on vertices that exist."""
    out = vertices
    wide = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(c).alias("c")) for d, c in ((-1, 0.25), (0, 0.5), (1, 0.25))])
    here = F.array(F.struct(F.lit(0).alias("d"), F.lit(1.0).alias("c")))
    for axis in _AXES:
        # the purely spatial kernel has a single colour bin
        shifts = wide if axis in ("vy", "vx") else F.when(F.col("kernel") == 0, here).otherwise(wide)
        spread = out.withColumn("_s", F.explode(shifts))
        spread = spread.select(*keys, "kernel", *[c for c in _AXES if c != axis], (F.col(axis) + F.col("_s.d")).alias(axis),
                               (F.col("val") * F.col("_s.c")).alias("val"), (F.col("_s.d") == 0).alias("_own"))
        out = (spread.groupBy(*keys, "kernel", *_AXES).agg(F.sum("val").alias("val"), F.max("_own").alias("_own"))
               .filter("_own").drop("_own"))
    return out


def _filter(taps: DataFrame, weight: str, keys: list[str], carry: list[str]) -> DataFrame:
    """Blurred value at each tap: rows (cell, kernel, carried columns, val)."""
    vertex = [*keys, "kernel", *_AXES]
    grid = _blur(taps.groupBy(*vertex).agg(F.sum(F.col(weight)).alias("val")), keys)
    return taps.select(*vertex, "y", "x", *carry).join(grid, vertex)


# a filter's reach in cells from which kernels go through tables of vertices: a block with its halo would no longer be small
WIDE = 200
_STATE = ["q", "n0", "n1", "m1"]


class _TooWide(Exception):
    """The grid of a table has more places than 64-bit numbers."""


class _Grid:
    """One kernel's vertices under the cells of a table of whole groups: splat, blur and slice as array code."""

    def __init__(self, group: np.ndarray, y: np.ndarray, x: np.ndarray, colours: list[np.ndarray], weight: np.ndarray, s_xy: np.ndarray, s_rgb: np.ndarray | None):
        with np.errstate(divide="ignore", invalid="ignore"):
            u, v = y / s_xy, x / s_xy
            bins = [np.floor(c / s_rgb + 0.5) for c in colours] if s_rgb is not None else []
        fu, fv = np.floor(u), np.floor(v)
        fine = (weight > 0) & np.isfinite(u) & np.isfinite(v) & np.all([np.isfinite(c) for c in bins] or [np.ones(len(y), bool)], axis=0)
        at, vy, vx, w = [], [], [], []
        for dy in (0, 1):
            for dx in (0, 1):
                part = ((u - fu) if dy else (1.0 - (u - fu))) * ((v - fv) if dx else (1.0 - (v - fv)))
                i = np.flatnonzero(fine & (part > 0))
                at.append(i)
                vy.append(fu[i] + dy)
                vx.append(fv[i] + dx)
                w.append(part[i])
        self.cells, self.at, self.w = len(y), np.concatenate(at), np.concatenate(w)
        self.kw = weight[self.at]
        axes = [np.concatenate(vy), np.concatenate(vx), *[c[self.at] for c in bins]]
        code, size, steps = np.zeros(len(self.at), np.int64), 1, []
        for axis in axes:  # a free place after the last of each axis, so that a step never runs into the next line
            low, high = (int(axis.min()), int(axis.max())) if len(axis) else (0, 0)
            steps.append(size)
            if size * (high - low + 2) >= 1 << 62:
                raise _TooWide
            code += (axis - low).astype(np.int64) * size
            size *= high - low + 2
        if size * (int(group[-1]) + 1 if len(group) else 1) >= 1 << 62:
            raise _TooWide
        code += group[self.at] * size
        vertex, self.vertex = np.unique(code, return_inverse=True)
        self.near = []
        for step in steps:
            for shift in (-step, step):
                to = np.searchsorted(vertex, vertex + shift)
                to[to == len(vertex)] = 0
                self.near.append(np.where(vertex[to] == vertex + shift, to, len(vertex)) if len(vertex) else to)

    def blurred(self, tap: np.ndarray) -> np.ndarray:
        """Values of taps summed onto vertices, blurred along each axis over occupied vertices, and read back at each tap."""
        val = np.zeros(int(self.vertex.max()) + 2 if len(self.vertex) else 1)  # the last place is that of missing neighbours
        val[:-1] = np.bincount(self.vertex, tap, len(val) - 1)
        for below, above in zip(self.near[::2], self.near[1::2], strict=True):
            val[:-1] = 0.5 * val[:-1] + 0.25 * (val[below] + val[above])
        return val[self.vertex]

    def by_cell(self, tap: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, tap, self.cells).astype(float)  # without taps it counts in integers


def _advance(table: pa.Table, group: np.ndarray, params: dict[str, float], first: int, last: int) -> dict[str, np.ndarray]:
    """The state of each cell after filters first .. last - 1: 0 normalises each kernel, 1 gives the message of ones, each further one is a mean-field step."""
    get = lambda c: table.column(c).to_numpy(zero_copy_only=False).astype(float)
    value = {n: get(n) if n in table.column_names else np.full(table.num_rows, params[n]) for n in KERNEL_PARAMS}
    y, x, colours = get("y"), get("x"), [get(c) for c in "rgb"]
    grids = [_Grid(group, y, x, colours, value["pos_w"], value["pos_xy_std"], None),
             _Grid(group, y, x, colours, value["bilateral_w"], value["bilateral_xy_std"], value["bilateral_rgb_std"])]
    p = get("p")
    logit = np.log(p / (1.0 - p))
    q, n0, n1, m1 = (get(c) for c in _STATE)
    norms = [n0, n1]
    wn = None
    for i in range(first, last):
        if i == 0:  # symmetric normalisation: every tap carries w / sqrt(K 1)
            norms = [g.by_cell(g.w * g.blurred(g.w)) for g in grids]
            continue
        if wn is None:
            wn = [g.w / np.sqrt(n[g.at] + 1e-20) for g, n in zip(grids, norms, strict=True)]
        if i == 1:
            m1 = sum(g.by_cell(g.kw * w * g.blurred(w)) for g, w in zip(grids, wn, strict=True))
        else:
            m = sum(g.by_cell(g.kw * w * g.blurred(w * q[g.at])) for g, w in zip(grids, wn, strict=True))
            with np.errstate(over="ignore"):
                q = 1.0 / (1.0 + np.exp(-(logit + 2.0 * m - m1)))
    return {"q": q, "n0": norms[0], "n1": norms[1], "m1": m1}


def _in_blocks(state: DataFrame, cfg: PairwiseConfig, keys: list[str], reach: int, first: int, last: int, block: int) -> DataFrame:
    """One pass: filters first .. last - 1 on blocks of cells with a halo of their common reach."""
    halo, names = reach * (last - first), [*keys, "_by", "_bx"]

    def span(axis: str) -> Column:
        own = F.floor(F.col(axis) / block)
        return F.sequence(F.least(own, F.greatest(F.floor((F.col(axis) - halo) / block), F.lit(0))), F.floor((F.col(axis) + halo) / block))

    sent = state.withColumn("_by", F.explode(span("y"))).withColumn("_bx", F.explode(span("x")))
    params = {n: float(getattr(cfg, n)) for n in KERNEL_PARAMS}
    kept = [c for c in state.columns if c not in _STATE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole_groups(batches, names):
            try:
                parts = [(table, _advance(table, number, params, first, last))]
            except _TooWide:  # colours of very many bins: one block at a time has room
                cuts = [*np.flatnonzero(np.diff(number, prepend=-1)), len(number)]
                some = [table.slice(i, j - i) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                parts = [(t, _advance(t, np.zeros(t.num_rows, np.int64), params, first, last)) for t in some]
            for t, new in parts:
                core = np.flatnonzero((np.floor_divide(t.column("y").to_numpy(), block) == t.column("_by").to_numpy()) & (np.floor_divide(t.column("x").to_numpy(), block) == t.column("_bx").to_numpy()))
                if len(core):
                    yield from with_columns(t.take(pa.array(core)), kept, **{c: v[core] for c, v in new.items()})

    schema = ddl(state, kept) + "".join(f", {c} double" for c in _STATE)
    return sent.repartition(*names).sortWithinPartitions(*names, "y", "x").mapInArrow(run, schema)


def pairwise_refine(cells: DataFrame, cfg: PairwiseConfig, keys: list[str] = TILE, widest: float | None = None, block: int = BLOCK) -> DataFrame:
    """Foreground probability and refined mask of a dense table with r, g, b, p (unary) and optional `buffer`.

    A kernel parameter that is a column of `cells` overrides `cfg`, so many settings can run in one plan with a setting id among the keys; `widest` is then
    the largest standard deviation in space of all settings, if the caller knows it.
    """
    cell = [*keys, "y", "x"]
    clip = F.col("buffer") if "buffer" in cells.columns else F.lit(True)
    own = [n for n in KERNEL_PARAMS if n in cells.columns]
    p = scores.clip01(F.col("p"))
    base = cells.select(*cell, "r", "g", "b", p.alias("p"), clip.alias("buffer"), *[F.col(n).cast("double").alias(n) for n in own])
    stds = [float(getattr(cfg, n)) for n in ("pos_xy_std", "bilateral_xy_std") if n not in own]
    if widest is None and (measured := [n for n in ("pos_xy_std", "bilateral_xy_std") if n in own]):
        base = cut(base, "unary")
        stds += [x for x in base.agg(*[F.max(n) for n in measured]).first() if x is not None]
    reach = max(1, math.ceil(3 * max([*stds, *([widest] if widest is not None else [])], default=0.0)))
    if reach > WIDE:
        return _through_vertices(base, cfg, keys)
    filters, block = 2 + cfg.steps, max(block, 2 * reach)
    state = base.withColumn("q", F.col("p")).withColumns({c: F.lit(0.0) for c in _STATE[1:]})
    most = max(1, block // (2 * reach))
    for first in range(0, filters, most):
        state = _in_blocks(state, cfg, keys, reach, first, min(filters, first + most), block)
        if first + most < filters:
            state = cut(state, "field")
    return state.select(*cell, F.col("q").alias("p_fg"), ((F.col("q") > 0.5) & F.col("buffer")).alias("mask"))


def _through_vertices(cells: DataFrame, cfg: PairwiseConfig, keys: list[str]) -> DataFrame:
    """The same by tables of grid vertices, for kernels of any width."""
    cell = [*keys, "y", "x"]
    params = [(F.col(n) if n in cells.columns else F.lit(getattr(cfg, n))).cast("double").alias(n) for n in KERNEL_PARAMS]
    base = cut(cells.select(*cell, "r", "g", "b", F.col("p").alias("q"), "buffer", *params), "unary")
    base = base.withColumn("logit", F.ln(F.col("q") / (1.0 - F.col("q"))))
    taps = cut(_taps(base, keys), "taps")
    # symmetric normalisation: every tap carries w / sqrt(K 1)
    ones = _filter(taps, "w", keys, ["w"]).groupBy(*cell, "kernel").agg(F.sum(F.col("w") * F.col("val")).alias("_k1"))
    normed = cut(taps.join(ones, [*cell, "kernel"]).select(
        *cell, "kernel", *_AXES, "kw", (F.col("w") / F.sqrt(F.col("_k1") + 1e-20)).alias("wn")), "normed")
    total = _filter(normed, "wn", keys, ["wn", "kw"]).groupBy(*cell).agg(
        F.sum(F.col("kw") * F.col("wn") * F.col("val")).alias("_m1"))
    # cells whose kernel weights are all 0 have no taps and keep their unary value
    fixed = cut(base.join(total, cell, "left").fillna(0.0, ["_m1"]).select(*cell, "logit", "_m1", "buffer", "q"), "fixed")
    state = None
    q = fixed.select(*cell, "q")
    for _ in range(cfg.steps):
        weighted = normed.join(q, cell).withColumn("_v", F.col("wn") * F.col("q"))
        message = _filter(weighted, "_v", keys, ["wn", "kw"]).groupBy(*cell).agg(
            F.sum(F.col("kw") * F.col("wn") * F.col("val")).alias("_m"))
        nxt = fixed.select(*cell, "logit", "_m1").join(message, cell, "left").select(
            *cell, (1.0 / (1.0 + F.exp(-(F.col("logit") + 2.0 * F.coalesce("_m", F.lit(0.0)) - F.col("_m1"))))).alias("q"))
        following = StepTable(nxt, "field")
        if state is not None:
            state.drop()
        state, q = following, following.df
    out = fixed.select(*cell, "buffer").join(q, cell)
    return out.select(*cell, F.col("q").alias("p_fg"), ((F.col("q") > 0.5) & F.col("buffer")).alias("mask"))


def unary(df: DataFrame, cfg: PairwiseConfig, center: float, score: str = "score", dilated: str | None = None,
          seed: str | None = None) -> DataFrame:
    """Unary probability column `p`: trimap when a band and its masks are given, else logistic around the threshold."""
    clip = F.col("buffer") if "buffer" in df.columns else None
    if cfg.trimap_band > 0 and dilated and seed:
        return df.withColumn("p", scores.clip01(scores.trimap(F.col(seed), F.col(dilated), clip)))
    return df.withColumn("p", scores.logistic(F.col(score), center, cfg.prob_softness, clip))


def stream_mask(df: DataFrame, score, threshold: float, tiles: DataFrame, buffer: DataFrame | None, fill: bool,
                keys: list[str] = TILE, block: int = BLOCK) -> DataFrame:
    """Threshold, median, clip to the buffer, then optional hole filling and clip again. The median sees all cells.

    Only cells above the threshold and those of the buffer travel, once and by block, so `df` may lack cells below it.
    """
    boxes = tiles.filter("height > 0 and width > 0").select(
        *keys, F.lit(0).alias("y0"), (F.col("height") - 1).cast("int").alias("y1"), F.lit(0).alias("x0"), (F.col("width") - 1).cast("int").alias("x1"))
    mask = df.filter(score >= F.lit(float(threshold))).select(*keys, "y", "x")
    return cleaned(mask, boxes, buffer, True, fill, keys, block).select(*keys, "y", "x")

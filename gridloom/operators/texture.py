"""Gradient texture of every window of whole tiles, from the cells that are given.

Cells cross the network once, with their gray value, to their square block of the tile (and to the next one if they lie beside its border). A block is laid out
densely in place; its windows take their lines and columns from it, so neither cells nor neighbours are shuffled or sorted once for each window.
Inside a window slopes are central, at its edges one-sided, as in `focal.gradient`; windows end at whole patches. A cell that is missing is black.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color
from .blocks import BLOCK, ddl, ints, ragged_ranges, whole_groups
from .features import EPS
from .tiling import TILE

#: Window cells that are laid out at a time.
_LAID = 1 << 18


class _Lines:
    """Lines [first, last) of a tile in each of its windows, by window: `win`, `line`, and if the window has a line `before` and `after` it."""

    def __init__(self, first: int, last: int, length: int, size: int, stride: int, ps: int):
        start = np.arange(0, length, stride)
        end = start + np.minimum(size, length - start) // ps * ps
        of, self.line = ragged_ranges(np.maximum(start, first), np.minimum(end, last))
        self.win, self.at = start[of], self.line - first + 1
        self.before, self.after = self.line > self.win, self.line < end[of] - 1


def _slope(gray: np.ndarray, lines: _Lines) -> np.ndarray:
    """Slopes along the second axis, for each window's own lines of it."""
    here = gray[:, lines.at]
    low, high = (np.where(has[:, None], gray[:, lines.at + step], here) for has, step in ((lines.before, -1), (lines.after, 1)))
    return (high - low) / np.where(lines.before & lines.after, 2.0, 1.0)[:, None]


def _laid_out(cells: DataFrame, tiles: DataFrame, size: int, stride: int, ps: int, keys: list[str], block: int, schema: str,
              measure: Callable[[np.ndarray, np.ndarray, _Lines, _Lines], tuple[list[np.ndarray], list[pa.Array]]]) -> DataFrame:
    """Rows of `measure(gy, gx, rows, columns)` for batches of equal blocks: where each of a block's rows is, and what was measured, block after block."""
    block = max(1, block // ps) * ps
    names = [*keys, "_by", "_bx"]
    gray = color.gray(*[F.coalesce(F.col(c), F.lit(0)) for c in "rgb"])

    def near(axis: str):
        return F.explode(F.expr(f"sequence(greatest({axis} - 1, 0) div {block}, ({axis} + 1) div {block})").cast("array<int>"))

    given = (cells.filter("y >= 0 and x >= 0").select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), gray.alias("gray"))
             .withColumn("_by", near("y")).withColumn("_bx", near("x")))
    # a row without a gray value: the size of the block's tile
    heads = tiles.filter("height > 0 and width > 0").select(*keys, F.col("height").cast("int").alias("y"), F.col("width").cast("int").alias("x"), F.lit(None).cast("double").alias("gray"))
    for name, axis in (("_by", "y"), ("_bx", "x")):
        heads = heads.withColumn(name, F.explode(F.expr(f"sequence(0, cast(({axis} - 1) div {block} as int))")))
    rows = given.unionByName(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole_groups(batches, names):
            empty = table.column("gray").is_null().to_numpy()
            head = np.flatnonzero(empty)
            head = head[np.unique(number[head], return_index=True)[1]]
            of = np.full(int(number[-1]) + 1, -1)  # blocks outside every tile have no head
            of[number[head]] = np.arange(len(head))
            at = table.take(pa.array(head))
            shapes, kind = np.unique(np.stack([ints(at, c) for c in ("y", "x", "_by", "_bx")], 1), axis=0, return_inverse=True)
            kind = kind.reshape(-1)
            cell = np.flatnonzero(~empty & (of[number] >= 0))
            of_cell, y, x, v = of[number[cell]], ints(table, "y")[cell], ints(table, "x")[cell], table.column("gray").to_numpy()[cell]
            for k, (height, width, by, bx) in enumerate(shapes.tolist()):
                top, left = by * block, bx * block
                h, w = min(height - top, block), min(width - left, block)
                lines, columns = _Lines(top, top + h, height, size, stride, ps), _Lines(left, left + w, width, size, stride, ps)
                own = np.flatnonzero(kind == k)
                place = np.full(len(head), -1)
                place[own] = np.arange(len(own))
                some = np.flatnonzero((place[of_cell] >= 0) & (y >= top - 1) & (y <= min(top + h, height - 1)) & (x >= left - 1) & (x <= min(left + w, width - 1)))
                p, r, c = place[of_cell[some]], y[some] - top + 1, x[some] - left + 1
                room = len(lines.line) * len(columns.line)
                step = max(1, _LAID // max(1, room))
                for low in range(0, len(own) if room else 0, step):
                    high = min(low + step, len(own))
                    a, b = np.searchsorted(p, [low, high])
                    frame = np.zeros((high - low, h + 2, w + 2))
                    frame[p[a:b] - low, r[a:b], c[a:b]] = v[some[a:b]]
                    gy = _slope(frame, lines)[:, :, columns.at]
                    gx = _slope(frame.transpose(0, 2, 1), columns).transpose(0, 2, 1)[:, lines.at]
                    where, values = measure(gy, gx, lines, columns)
                    tile = at.select(keys).take(pa.array(np.repeat(own[low:high], len(where[0]))))
                    out = pa.table([*tile.columns, *[pa.array(np.tile(i.astype(np.int32), high - low)) for i in where], *values], names=out_names)
                    yield from out.combine_chunks().to_batches()

    out_names = [*keys, *[c.split()[0] for c in schema.split(", ")]]
    return rows.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, ddl(rows, keys) + (", " if keys else "") + schema)


def _grid(lines: np.ndarray, columns: np.ndarray) -> list[np.ndarray]:
    return [i.reshape(-1) for i in np.meshgrid(lines, columns, indexing="ij")]


def _polar(gy: np.ndarray, gx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    angle = np.arctan2(gy, gx)
    return np.sqrt(gx * gx + gy * gy), np.where(angle < 0, angle + 2 * math.pi, angle)


def window_texture(cells: DataFrame, tiles: DataFrame, size: int, stride: int, ps: int, keys: list[str] = TILE, block: int = BLOCK) -> DataFrame:
    """Gradient magnitude and angle (`mag`, `ori`) of every cell of every window."""
    def measure(gy: np.ndarray, gx: np.ndarray, lines: _Lines, columns: _Lines):
        where = [*_grid(lines.win, columns.win), *_grid(lines.line, columns.line)]
        return [where[0], where[1], where[2], where[3]], [pa.array(i.reshape(-1)) for i in _polar(gy, gx)]

    return _laid_out(cells, tiles, size, stride, ps, keys, block, "win_y int, win_x int, y int, x int, mag double, ori double", measure)


def _patches(cells: DataFrame, tiles: DataFrame, size: int, stride: int, ps: int, keys: list[str], block: int, schema: str, summary: Callable[[np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    if stride % ps:
        raise ValueError("the stride is no multiple of the patch size")

    def measure(gy: np.ndarray, gx: np.ndarray, lines: _Lines, columns: _Lines):
        win, patch = zip(*[(i.win[::ps], (i.line[::ps] - i.win[::ps]) // ps) for i in (lines, columns)], strict=True)
        n, high, wide = gy.shape
        # a patch's cells beside each other
        mag, ori = (i.reshape(n, high // ps, ps, wide // ps, ps).swapaxes(2, 3).reshape(-1, ps * ps) for i in _polar(gy, gx))
        return [*_grid(*win), *_grid(*patch)], summary(mag, ori)

    return _laid_out(cells, tiles, size, stride, ps, keys, block, f"win_y int, win_x int, py int, px int, {schema}", measure)


def patch_gradients(cells: DataFrame, tiles: DataFrame, size: int, stride: int, ps: int, keys: list[str] = TILE, block: int = BLOCK) -> DataFrame:
    """`features.grad_stats` of every patch of every window."""
    def summary(mag: np.ndarray, ori: np.ndarray) -> list[pa.Array]:
        # sums in order of rows, as a plain loop: where a mean lies halfway between two rounded values, the last digit decides
        mean = mag.cumsum(1)[:, -1:] / mag.shape[1]
        return [pa.array(mean[:, 0]), pa.array(np.sqrt(np.square(mag - mean).mean(1)))]

    return _patches(cells, tiles, size, stride, ps, keys, block, "mag_mean double, mag_std double", summary)


def patch_orientations(cells: DataFrame, tiles: DataFrame, size: int, stride: int, ps: int, bins: int = 8, keys: list[str] = TILE, block: int = BLOCK) -> DataFrame:
    """`features.orient_hist` of every patch of every window."""
    def summary(mag: np.ndarray, ori: np.ndarray) -> list[pa.Array]:
        slot = np.clip(np.floor(ori / (2 * math.pi) * bins), 0, bins - 1).astype(np.int64) + np.arange(len(mag))[:, None] * bins
        hist = np.bincount(slot.reshape(-1), mag.reshape(-1), len(mag) * bins).reshape(-1, bins)
        hist = hist / (hist.sum(1, keepdims=True) + EPS)
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(hist) + 1, dtype=np.int32) * np.int32(bins)), pa.array(hist.reshape(-1)))]

    return _patches(cells, tiles, size, stride, ps, keys, block, "hist array<double>", summary)

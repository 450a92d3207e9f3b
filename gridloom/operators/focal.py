"""Neighbourhood operators on masks, cell values and patch vectors.

Masks are sparse: a row means the cell is set. Binary operators work on row runs
(maximal intervals of set cells in one row), so their cost follows the number of runs and of output
cells, not the area of the structuring element. Every shuffle key contains the tile and a row,
column or cell, never the tile alone, so one huge tile spreads over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, vectors
from .blocks import ddl, ints, whole_groups
from .tiling import PATCH, TILE, WINDOW, with_dims


def half_widths(r: int, kernel: str = "disk") -> list[tuple[int, int]]:
    """(dy, half width) rows of a structuring element."""
    out = []
    for dy in range(-r, r + 1):
        if kernel == "disk":
            hw = math.isqrt(r * r - dy * dy)
        elif kernel == "ellipse":
            hw = round(math.sqrt(r * r - dy * dy))
        elif kernel == "diamond":
            hw = r - abs(dy)
        elif kernel == "square":
            hw = r
        else:
            raise ValueError(f"unknown kernel {kernel}")
        out.append((dy, hw))
    return out


def _kernel_rows(r: int, kernel: str) -> Column:
    return F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(hw).alias("hw")) for dy, hw in half_widths(r, kernel)])


def runs(mask: DataFrame, keys: list[str] = TILE) -> DataFrame:
    """Maximal intervals (y, x0, x1) of set cells; a window holds one row of one tile."""
    w = Window.partitionBy(*keys, "y").orderBy("x")
    return (
        mask.select(*keys, "y", "x").withColumn("_g", F.col("x") - F.row_number().over(w))
        .groupBy(*keys, "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g")
    )


def merge_intervals(spans: DataFrame, keys: list[str] = TILE) -> DataFrame:
    """Union of overlapping or touching intervals of each row."""
    w = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    seen = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.withColumn("_new", F.when(seen.isNull() | (F.col("x0") > seen + 1), 1).otherwise(0))
    return (
        starts.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "y", "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_g")
    )


def run_cells(spans: DataFrame, extra: list[str] | None = None, keys: list[str] = TILE) -> DataFrame:
    cols = [*keys, *(extra or [])]
    return spans.select(*cols, "y", F.explode(F.sequence(F.col("x0").cast("int"), F.col("x1").cast("int"))).alias("x"))


def dilate(mask: DataFrame, tiles: DataFrame, r: int, kernel: str = "disk", keys: list[str] = TILE) -> DataFrame:
    """Binary dilation clipped to the tile: widen each run per kernel row, then merge intervals."""
    if r <= 0:
        return mask.select(*keys, "y", "x")
    wide = (
        with_dims(runs(mask, keys), tiles, keys).withColumn("_k", F.explode(_kernel_rows(r, kernel)))
        .select(*keys,
                (F.col("y") + F.col("_k.dy")).cast("int").alias("y"),
                F.greatest(F.lit(0), F.col("x0") - F.col("_k.hw")).cast("int").alias("x0"),
                F.least(F.col("width") - 1, F.col("x1") + F.col("_k.hw")).cast("int").alias("x1"), "height")
        .filter("y >= 0 and y < height and x0 <= x1").drop("height")
    )
    return run_cells(merge_intervals(wide, keys), keys=keys)


def erode(mask: DataFrame, tiles: DataFrame, r: int, kernel: str = "disk", outside_set: bool = True,
          keys: list[str] = TILE) -> DataFrame:
    """Binary erosion: a cell stays when, for every kernel row, one run covers its whole interval."""
    if r <= 0:
        return mask.select(*keys, "y", "x")
    left = F.col("x0") + F.col("_k.hw")
    right = F.col("x1") - F.col("_k.hw")
    rows_needed = F.lit(2 * r + 1)
    if outside_set:
        left = F.when(F.col("x0") == 0, 0).otherwise(left)
        right = F.when(F.col("x1") == F.col("width") - 1, F.col("width") - 1).otherwise(right)
        rows_needed = F.least(F.col("y") + r, F.col("height") - 1) - F.greatest(F.col("y") - r, F.lit(0)) + 1
    support = (
        with_dims(runs(mask, keys), tiles, keys).withColumn("_k", F.explode(_kernel_rows(r, kernel)))
        .select(*keys, (F.col("y") - F.col("_k.dy")).cast("int").alias("y"),
                left.cast("int").alias("x0"), right.cast("int").alias("x1"), "height")
        .filter("y >= 0 and y < height and x0 <= x1")
        .withColumn("_need", rows_needed)
    )
    # every kernel row's intervals as +1 and -1 events of a row; cells are generated only where all kernel rows cover
    events = (
        support.withColumn("_e", F.explode(F.array(F.struct(F.col("x0").alias("at"), F.lit(1).alias("d")), F.struct((F.col("x1") + 1).alias("at"), F.lit(-1).alias("d")))))
        .groupBy(*keys, "y", F.col("_e.at").alias("at")).agg(F.sum("_e.d").alias("_d"), F.max("_need").alias("_need"))
    )
    w = Window.partitionBy(*keys, "y").orderBy("at")
    covered = (events.withColumn("_have", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("x1", F.lead("at").over(w) - 1)
               .filter("_have = _need").select(*keys, "y", F.col("at").alias("x0"), "x1"))
    return run_cells(covered, keys=keys)


def focal(df: DataFrame, tiles: DataFrame, offsets: list[tuple[int, int]], value: str, border: str = "reflect",
          fill: float = 0.0, keys: list[str] = TILE) -> DataFrame:
    """Value at each offset for each cell of a dense table: rows (keys, y, x, dy, dx, value)."""
    table = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    target = with_dims(df.select(*keys, "y", "x"), tiles, keys).withColumn("_o", F.explode(table))
    sy, sx = F.col("y") + F.col("_o.dy"), F.col("x") + F.col("_o.dx")
    if border == "reflect":
        sy, sx = scores.reflect(sy, F.col("height")), scores.reflect(sx, F.col("width"))
    elif border != "constant":
        raise ValueError(f"unknown border rule {border}")
    target = target.select(*keys, "y", "x", F.col("_o.dy").alias("dy"), F.col("_o.dx").alias("dx"),
                           sy.cast("int").alias("_sy"), sx.cast("int").alias("_sx"))
    source = df.select(*keys, F.col("y").alias("_sy"), F.col("x").alias("_sx"), F.col(value))
    out = target.join(source, [*keys, "_sy", "_sx"], "left").drop("_sy", "_sx")
    return out.fillna({value: fill}) if border == "constant" else out


def median3(mask: DataFrame, tiles: DataFrame, keys: list[str] = TILE) -> DataFrame:
    """3x3 binary median with repeated edges: at least five of the nine samples are set.

    What travels are rows of a tile as lists of columns, to themselves and the rows beside them; columns are counted in place, batch by batch.
    """
    y, h = F.col("y"), F.col("height")
    own = F.lit(1) + (y == 0).cast("int") + (y == h - 1).cast("int")
    to = F.filter(F.array(*[F.struct((y + dy).alias("at"), w.alias("w")) for dy, w in ((-1, F.lit(1)), (0, own), (1, F.lit(1)))]), lambda t: (t["at"] >= 0) & (t["at"] < h))
    rows = with_dims(mask.groupBy(*keys, "y").agg(F.collect_list("x").alias("xs")), tiles, keys).withColumn("_t", F.explode(to))
    met = rows.groupBy(*keys, F.col("_t.at").cast("int").alias("y"), "width").agg(
        F.flatten(F.collect_list("xs")).alias("xs"), F.flatten(F.collect_list(F.array_repeat("_t.w", F.size("xs")))).alias("ws"))
    cell = mask.select(*keys, F.col("y").cast("int"), F.col("x").cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            xs = batch.column("xs")
            row = np.repeat(np.arange(batch.num_rows), xs.value_lengths().to_numpy())
            x, w, n = xs.flatten().to_numpy().astype(np.int64), batch.column("ws").flatten().to_numpy(), batch.column("width").to_numpy()
            size = int(n.max())
            n = n[row]
            inside = [x > 0, np.ones(len(x), bool), x < n - 1]
            at = np.concatenate([(row * size + x + dx)[k] for dx, k in zip((-1, 0, 1), inside, strict=True)])
            much = np.concatenate([(w * (1 + (x == 0) + (x == n - 1)) if dx == 0 else w)[k] for dx, k in zip((-1, 0, 1), inside, strict=True)])
            found, of = np.unique(at, return_inverse=True)
            found = found[np.bincount(of, much, len(found)) >= 5]
            took = batch.select([*keys, "y"]).take(pa.array(found // size))
            yield pa.RecordBatch.from_arrays([*took.columns, pa.array((found % size).astype(np.int32))], names=[*keys, "y", "x"])

    return met.mapInArrow(run, cell.schema)


# fixed values: neighbour order of bit codes, NW N NE E SE S SW W as (dy, dx)
RING8 = ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))


def neighbour_bits(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Set cells with a byte whose bit k says that neighbour k is set; `keys` may include an object id."""
    sends = [F.struct(F.lit(0).alias("dy"), F.lit(0).alias("dx"), F.lit(256).alias("bit"))]
    for k, (dy, dx) in enumerate(RING8):
        sends.append(F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx"), F.lit(1 << k).alias("bit")))
    return (
        mask.select(*keys, "y", "x").withColumn("_o", F.explode(F.array(*sends)))
        .groupBy(*keys, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"))
        .agg(F.bit_or("_o.bit").alias("_b")).filter("_b >= 256")
        .select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"),
                (F.col("_b") - 256).alias("bits"))
    )


def inner_boundary(comp: DataFrame, keys: list[str]) -> DataFrame:
    """Object cells with a side neighbour outside the object (outside the tile counts as outside)."""
    sides = (1 << 1) | (1 << 3) | (1 << 5) | (1 << 7)
    return (neighbour_bits(comp, keys).filter(F.col("bits").bitwiseAND(sides) != sides).select(*keys, "y", "x"))


def boundary_band_errors(pred: DataFrame, gt: DataFrame, tiles: DataFrame, n: int, keys: list[str] = TILE) -> DataFrame:
    """False positives and negatives within `n` side steps of the ground-truth boundary."""
    cell = [*keys, "y", "x"]
    boundary = gt.select(*cell).join(erode(gt, tiles, 1, "diamond", False, keys), cell, "left_anti")
    band = dilate(boundary, tiles, n, "diamond", keys)
    both = (pred.select(*cell, F.lit(1).alias("p"), F.lit(0).alias("g"))
            .unionByName(gt.select(*cell, F.lit(0).alias("p"), F.lit(1).alias("g")))
            .groupBy(*cell).agg(F.max("p").alias("p"), F.max("g").alias("g")).filter("p <> g"))
    return both.join(band, cell, "left_semi").select(*cell, F.when(F.col("p") == 1, "fp").otherwise("fn").alias("kind"))


def _reflected(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places with repeated edges: -1 is 0 and n is n - 1, then on and back."""
    at = np.mod(at, 2 * n)
    return np.where(at < n, at, 2 * n - 1 - at)


def _axis_sum(vecs: DataFrame, group: list[str], along: str, size: str, r: int, kept: list[str]) -> DataFrame:
    """Sums of the vectors within r places along one axis; a group is one line of patches of one window, and absent patches count as zero."""
    names = [*group, along]
    schema = ddl(vecs, kept) + ", v array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole_groups(batches, group, 20_000):
            column = table.column("v").combine_chunks()
            m = column.flatten().to_numpy().reshape(table.num_rows, -1)
            first = np.flatnonzero(np.diff(number, prepend=-1))
            n, at = ints(table, size), ints(table, along)
            start = (np.cumsum(n[first]) - n[first])[number]
            dense = np.zeros((int(n[first].sum()), m.shape[1]))
            dense[start + at] = m
            total = sum(dense[start + _reflected(at + d, n)] for d in range(-r, r + 1))
            out = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, max(total.shape[1], 1), dtype=np.int32)), pa.array(total.reshape(-1)))
            yield from pa.table([*[table.column(c) for c in kept], out], names=[*kept, "v"]).combine_chunks().to_batches()

    return vecs.repartition(*group).sortWithinPartitions(*names).mapInArrow(run, schema)


def local_mean(vecs: DataFrame, r: int, keys: list[str] = TILE) -> DataFrame:
    """(2r+1)^2 mean of patch vectors inside each window with repeated edges, then unit length: sums along rows, then along columns; each vector is shuffled twice, whatever r is."""
    if r <= 0:
        return vecs
    win = [*keys, *WINDOW]
    sizes = vecs.groupBy(*win).agg((F.max("py") + 1).alias("_hp"), (F.max("px") + 1).alias("_wp"))
    kept = [*win, *PATCH, "_hp", "_wp"]
    placed = vecs.join(sizes, win).select(*kept, vectors.to_double(F.col("vec")).alias("v"))
    rows = _axis_sum(placed, [*win, "py"], "px", "_wp", r, kept)
    both = _axis_sum(rows, [*win, "px"], "py", "_hp", r, kept)
    mean = F.transform("v", lambda x: x * F.lit(1.0 / float((2 * r + 1) ** 2)))
    return both.select(*win, *PATCH, vectors.l2(mean).alias("vec"))


def window_neighbours(df: DataFrame, value: str, keys: list[str] = TILE) -> DataFrame:
    """Eight neighbour values inside each window (null past its edge).

    A sort group is one row or one column of one window.
    """
    across = Window.partitionBy(*keys, *WINDOW, "y").orderBy("x")
    down = Window.partitionBy(*keys, *WINDOW, "x").orderBy("y")
    out = df.withColumn("n_w", F.lag(value).over(across)).withColumn("n_e", F.lead(value).over(across))
    for name, src, fn in (("n_n", value, F.lag), ("n_s", value, F.lead), ("n_nw", "n_w", F.lag), ("n_ne", "n_e", F.lag),
                          ("n_sw", "n_w", F.lead), ("n_se", "n_e", F.lead)):
        out = out.withColumn(name, fn(src).over(down))
    return out


def _slope(before: Column, here: Column, after: Column) -> Column:
    return (F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - here)
            .when(after.isNull(), here - before).otherwise((after - before) / 2.0))


def gradient_cols(value: str) -> dict[str, Column]:
    """Row and column slopes from neighbour columns: central inside, one-sided at the edges."""
    v = F.col(value)
    return {"gy": _slope(F.col("n_n"), v, F.col("n_s")), "gx": _slope(F.col("n_w"), v, F.col("n_e"))}


def gradient(df: DataFrame, value: str, keys: list[str] = TILE) -> DataFrame:
    near = window_neighbours(df, value, keys)
    g = gradient_cols(value)
    return near.select(*df.columns, g["gy"].alias("gy"), g["gx"].alias("gx"))


def lbp_code(value: str) -> Column:
    """Bit k is set when neighbour k is not below the centre; null on the window border."""
    names = ("n_nw", "n_n", "n_ne", "n_e", "n_se", "n_s", "n_sw", "n_w")
    code = F.lit(0)
    for k, name in enumerate(names):
        code = code + F.when(F.col(name) >= F.col(value), 1 << k).when(F.col(name).isNotNull(), 0)
    return code


def lbp(df: DataFrame, value: str, keys: list[str] = TILE) -> DataFrame:
    near = window_neighbours(df, value, keys)
    return near.select(*df.columns, lbp_code(value).alias("code")).filter("code is not null")

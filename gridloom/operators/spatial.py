"""Joins with space: candidates, rasterising, clipping, reprojection, mosaic grids.

A geometry is `rings ARRAY<ARRAY<STRUCT<x, y>>>` (even-odd filling). A tile has `left`, `top`, `px` (cell size),
`height`, `width`; rows go down from `top`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from .blocks import ddl, ints, whole_groups, with_columns
from .focal import merge_intervals, run_cells
from .tiling import TILE, with_dims


def with_bbox(geoms: DataFrame) -> DataFrame:
    pts = F.flatten("rings")
    return (geoms.withColumn("min_x", F.array_min(F.transform(pts, lambda p: p["x"])))
            .withColumn("max_x", F.array_max(F.transform(pts, lambda p: p["x"])))
            .withColumn("min_y", F.array_min(F.transform(pts, lambda p: p["y"])))
            .withColumn("max_y", F.array_max(F.transform(pts, lambda p: p["y"]))))


def tile_boxes(tiles: DataFrame) -> DataFrame:
    return (tiles.withColumn("min_x", F.col("left")).withColumn("max_x", F.col("left") + F.col("width") * F.col("px"))
            .withColumn("max_y", F.col("top")).withColumn("min_y", F.col("top") - F.col("height") * F.col("px")))


def _bucketed(df: DataFrame, size: float) -> DataFrame:
    def cells(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(lo) / F.lit(float(size))), F.floor(F.col(hi) / F.lit(float(size))))

    return (df.filter("min_x <= max_x and min_y <= max_y").withColumn("_bx", F.explode(cells("min_x", "max_x")))
            .withColumn("_by", F.explode(cells("min_y", "max_y"))))


def bbox_join(a: DataFrame, b: DataFrame, bucket: float) -> DataFrame:
    """Pairs with overlapping boxes, through an equi-join on grid buckets.

    Both sides carry min_x..max_y; the right side's come out with the suffix `_b`. A pair found in several buckets
    is kept only in the one that holds the lower corner of the common box, so no distinct is needed.
    """
    right = _bucketed(b, bucket)
    for c in ("min_x", "max_x", "min_y", "max_y"):
        right = right.withColumnRenamed(c, f"{c}_b")
    pairs = _bucketed(a, bucket).join(right, ["_bx", "_by"])
    hit = ((F.col("min_x") <= F.col("max_x_b")) & (F.col("min_x_b") <= F.col("max_x"))
           & (F.col("min_y") <= F.col("max_y_b")) & (F.col("min_y_b") <= F.col("max_y")))
    home = ((F.floor(F.greatest("min_x", "min_x_b") / F.lit(float(bucket))) == F.col("_bx"))
            & (F.floor(F.greatest("min_y", "min_y_b") / F.lit(float(bucket))) == F.col("_by")))
    return pairs.filter(hit & home).drop("_bx", "_by")


def ring_edges(ring: Column) -> Column:
    """Consecutive point pairs of a ring, closed."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.filter(F.zip_with(ring, nxt, lambda p, q: F.struct(
        p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1"))),
        lambda e: (e["x0"] != e["x1"]) | (e["y0"] != e["y1"]))


def edges(geoms: DataFrame, keep: list[str]) -> DataFrame:
    return (geoms.select(*keep, F.explode("rings").alias("_r"))
            .select(*keep, F.explode(ring_edges(F.col("_r"))).alias("_e")).select(*keep, "_e.*"))


GEOM = ["layer", "geom_id"]


def _between(lo: Column, hi: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / F.lit(float(size))), F.floor(hi / F.lit(float(size)))))


def edges_meeting_boxes(sides: DataFrame, boxes: DataFrame, bucket: float, keep: list[str], keys: list[str]) -> DataFrame:
    """Distinct (keep, keys) for which an edge meets a box. An edge is dealt to the buckets along its own line, not to those of its box."""
    rows = sides.withColumn("_by", _between(F.least("y0", "y1"), F.greatest("y0", "y1"), bucket))
    # x of the edge where it enters and leaves the bucket row, a little widened against rounding
    def x_at(y: Column) -> Column:
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - F.col("y0")) / F.nullif(F.col("y1") - F.col("y0"), F.lit(0.0))))
        return F.col("x0") + t * (F.col("x1") - F.col("x0"))

    low, high = x_at(F.col("_by") * F.lit(float(bucket))), x_at((F.col("_by") + 1) * F.lit(float(bucket)))
    flat = F.col("y0") == F.col("y1")
    a, b = F.when(flat, F.col("x0")).otherwise(low), F.when(flat, F.col("x1")).otherwise(high)
    slack = (F.abs(F.col("x0")) + F.abs(F.col("x1")) + 1.0) * 1e-12
    dealt = rows.withColumn("_bx", _between(F.least(a, b) - slack, F.greatest(a, b) + slack, bucket))
    met = dealt.join(_bucketed(boxes, bucket).select(*keys, "_bx", "_by", "min_x", "max_x", "min_y", "max_y"), ["_bx", "_by"])

    def side(cx: str, cy: str) -> Column:
        return (F.col("x1") - F.col("x0")) * (F.col(cy) - F.col("y0")) - (F.col("y1") - F.col("y0")) * (F.col(cx) - F.col("x0"))

    corners = [side(x, y) for x in ("min_x", "max_x") for y in ("min_y", "max_y")]
    hit = ((F.least("x0", "x1") <= F.col("max_x")) & (F.greatest("x0", "x1") >= F.col("min_x")) & (F.least("y0", "y1") <= F.col("max_y"))
           & (F.greatest("y0", "y1") >= F.col("min_y")) & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0))
    return met.filter(hit).select(*keep, *keys).distinct()


def _meet_in_y(sides: DataFrame, lines: DataFrame, bucket: float, lo: str, hi: str) -> DataFrame:
    """Edges and the `lines` rows whose [lo, hi] their own height range meets, each pair once."""
    left = sides.withColumn("_b", _between(F.least("y0", "y1"), F.greatest("y0", "y1"), bucket))
    right = lines.withColumn("_b", _between(F.col(lo), F.col(hi), bucket))
    home = F.floor(F.greatest(F.least("y0", "y1"), F.col(lo)) / F.lit(float(bucket))) == F.col("_b")
    return left.join(right, "_b").filter(home & (F.least("y0", "y1") <= F.col(hi)) & (F.greatest("y0", "y1") >= F.col(lo))).drop("_b")


def _inside(crossings: DataFrame, line: list[str]) -> DataFrame:
    """Intervals [a, b) inside a geometry on each line, from its crossings `at`; a window holds the crossings of one line by one geometry."""
    w = Window.partitionBy(*GEOM, *line).orderBy("at")
    paired = crossings.withColumn("_i", F.row_number().over(w)).withColumn("b", F.lead("at").over(w)).filter("_i % 2 = 1")
    return paired.select(*GEOM, *line, F.col("at").alias("a"), "b")


def _crossing(y: Column) -> Column:
    return F.col("x0") + (y - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))


def spatial_join(geoms: DataFrame, tiles: DataFrame, bucket: float, keys: list[str] = TILE) -> DataFrame:
    """(layer, geom_id, tile keys) of the geometries and tiles that really intersect.

    An edge meets the tile, or none does and the tile lies inside: then its lower left corner is inside on the line through it. Only edges are joined, so a
    geometry of many rings over many tiles is never copied.
    """
    sides, boxes = edges(geoms, GEOM), tile_boxes(tiles)
    met = edges_meeting_boxes(sides, boxes, bucket, GEOM, keys)
    lines = boxes.select(F.col("min_y").alias("line")).distinct()
    crossed = _meet_in_y(sides, lines.withColumn("_top", F.col("line")), bucket, "line", "_top").filter((F.col("y0") > F.col("line")) != (F.col("y1") > F.col("line")))
    spans = _inside(crossed.select(*GEOM, "line", _crossing(F.col("line")).alias("at")), ["line"]).filter("a < b")
    corners = boxes.select(*keys, F.col("min_y").alias("line"), F.col("min_x").alias("corner"), F.floor(F.col("min_x") / F.lit(float(bucket))).alias("_b"))
    within = spans.withColumn("_b", _between(F.col("a"), F.col("b"), bucket)).join(corners, ["line", "_b"]).filter("corner >= a and corner < b")
    return met.unionByName(within.select(*GEOM, *keys)).distinct()


BAND = ["top", "px", "height"]


def _rows_of(lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(F.greatest(lo, F.lit(0)).cast("int"), F.least(hi, F.col("height") - 1).cast("int")))


def rasterize(geoms: DataFrame, tiles: DataFrame, all_touched: bool, bucket: float, keys: list[str] = TILE) -> DataFrame:
    """Cells burnt per layer: those touched by a geometry, or those whose centre lies inside.

    Tiles of equal top, cell size and height form a band and share their rows. Edges meet bands by their own height range; each row's crossings are sorted and paired
    in map coordinates, once for all tiles of the band, and only the row intervals meet tiles. A geometry over any number of tiles thus costs its edges' rows.
    """
    sides = edges(geoms, GEOM)
    bands = tiles.select(*BAND).distinct().withColumn("_low", F.col("top") - F.col("height") * F.col("px"))
    met = _meet_in_y(sides, bands, bucket, "_low", "top")
    row0, row1 = (F.col("top") - F.col("y0")) / F.col("px"), (F.col("top") - F.col("y1")) / F.col("px")
    met = met.withColumn("r0", row0).withColumn("r1", row1)
    lo, hi = F.ceil(F.least("r0", "r1") - F.lit(0.5)), F.ceil(F.greatest("r0", "r1") - F.lit(0.5)) - 1
    on_row = met.filter(F.greatest(lo, F.lit(0)) <= F.least(hi, F.col("height") - 1)).withColumn("y", _rows_of(lo, hi))
    at = F.col("x0") + (F.col("y") + F.lit(0.5) - F.col("r0")) * (F.col("x1") - F.col("x0")) / (F.col("r1") - F.col("r0"))
    spans = _inside(on_row.select(*GEOM, *BAND, "y", at.alias("at")), [*BAND, "y"]).select("layer", *BAND, "y", "a", "b", F.lit(True).alias("centre"))
    if all_touched:
        lo, hi = F.floor(F.least("r0", "r1")), F.floor(F.greatest("r0", "r1"))
        banded = met.filter(F.greatest(lo, F.lit(0)) <= F.least(hi, F.col("height") - 1)).withColumn("y", _rows_of(lo, hi))

        def x_at(y: Column) -> Column:
            t = (y - F.col("r0")) / F.nullif(F.col("r1") - F.col("r0"), F.lit(0.0))
            return F.col("x0") + F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * (F.col("x1") - F.col("x0"))

        flat = F.col("r0") == F.col("r1")
        a = F.when(flat, F.col("x0")).otherwise(x_at(F.col("y").cast("double")))
        b = F.when(flat, F.col("x1")).otherwise(x_at(F.col("y") + F.lit(1.0)))
        spans = spans.unionByName(banded.select("layer", *BAND, "y", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.lit(False).alias("centre")))
    boxes = tile_boxes(tiles)
    placed = boxes.withColumn("_b", _between(F.col("min_x"), F.col("max_x"), bucket)).select(*keys, *BAND, "left", "width", "min_x", "max_x", "_b")
    pairs = spans.withColumn("_b", _between(F.col("a"), F.col("b"), bucket)).join(placed, [*BAND, "_b"])
    pairs = pairs.filter((F.col("a") <= F.col("max_x")) & (F.col("b") >= F.col("min_x")) & (F.floor(F.greatest("a", "min_x") / F.lit(float(bucket))) == F.col("_b")))
    first, last = (F.col("a") - F.col("left")) / F.col("px"), (F.col("b") - F.col("left")) / F.col("px")
    x0 = F.when(F.col("centre"), F.ceil(first - F.lit(0.5))).otherwise(F.floor(first))
    x1 = F.when(F.col("centre"), F.ceil(last - F.lit(0.5)) - 1).otherwise(F.floor(last))
    rows = pairs.select("layer", *keys, "y", F.greatest(x0, F.lit(0)).cast("int").alias("x0"), F.least(x1, F.col("width") - 1).cast("int").alias("x1")).filter("x0 <= x1")
    return run_cells(merge_intervals(rows, ["layer", *keys]), keys=["layer", *keys])


def clip_to_tiles(geoms: DataFrame, tiles: DataFrame, bucket: float, keys: list[str] = TILE) -> DataFrame:
    """Geometries clipped to each tile that they intersect: (layer, geom_id, tile keys, rings). Rings are oriented once per geometry, before any pair exists."""
    turned = geoms.withColumn("rings", oriented(F.col("rings")))
    box = tile_boxes(tiles).select(*keys, *[F.col(c).alias(f"{c}_b") for c in ("min_x", "max_x", "min_y", "max_y")])
    pairs = spatial_join(geoms, tiles, bucket, keys).join(turned, GEOM).join(box, keys)
    return _clip_to_boxes(pairs).select(*GEOM, *keys, "rings")


def _clip_to_boxes(pairs: DataFrame) -> DataFrame:
    """Clip oriented rings to the boxes beside them (one pass per side of the box), drop empty results."""
    def clip(ring: Column, axis: str, keep_above: bool, bound: Column) -> Column:
        other = "y" if axis == "x" else "x"
        lo = {"x": "x0", "y": "y0"}
        hi = {"x": "x1", "y": "y1"}

        def inside(v: Column) -> Column:
            return v >= bound if keep_above else v <= bound

        def step(e: Column) -> Column:
            a, b = e[lo[axis]], e[hi[axis]]
            t = (bound - a) / F.nullif(b - a, F.lit(0.0))
            cut_at = e[lo[other]] + t * (e[hi[other]] - e[lo[other]])
            cross = F.struct((bound if axis == "x" else cut_at).alias("x"), (cut_at if axis == "x" else bound).alias("y"))
            end = F.struct(e["x1"].alias("x"), e["y1"].alias("y"))
            none = F.slice(F.array(end), 1, 0)
            return (F.when(inside(a) & inside(b), F.array(end)).when(inside(a), F.array(cross))
                    .when(inside(b), F.array(cross, end)).otherwise(none))

        return F.flatten(F.transform(ring_edges(ring), step))

    def one_side(axis: str, above: bool, bound: str) -> Column:
        return F.transform("rings", lambda r: clip(r, axis, above, F.col(bound)))

    out = pairs
    for axis, above, bound in (("x", True, "min_x_b"), ("x", False, "max_x_b"), ("y", True, "min_y_b"), ("y", False, "max_y_b")):
        out = out.withColumn("rings", one_side(axis, above, bound))
    out = out.withColumn("rings", F.filter("rings", lambda r: F.size(r) >= 3))
    return out.filter((F.size("rings") > 0) & (ring_area_sum(F.col("rings")) > 0))


def ring_area(ring: Column) -> Column:
    """Signed shoelace area, positive for a counter-clockwise ring."""
    return F.aggregate(ring_edges(ring), F.lit(0.0), lambda acc, e: acc + (e["x0"] * e["y1"] - e["x1"] * e["y0"])) / 2.0


def ring_area_sum(rings: Column) -> Column:
    """Area of a geometry whose rings are oriented: holes count against what they are in."""
    return F.abs(F.aggregate(F.transform(rings, ring_area), F.lit(0.0), lambda acc, a: acc + a))


def oriented(rings: Column) -> Column:
    """Rings inside an even number of others counter-clockwise, holes clockwise (even-odd rule; rings do not cross each other)."""
    def inside(p: Column, ring: Column) -> Column:
        crossings = F.filter(ring_edges(ring), lambda e: ((e["y0"] > p["y"]) != (e["y1"] > p["y"])) & (
            p["x"] < e["x0"] + (e["x1"] - e["x0"]) * (p["y"] - e["y0"]) / F.nullif(e["y1"] - e["y0"], F.lit(0.0))))
        return F.size(crossings) % 2 == 1

    def turned(ring: Column) -> Column:
        around = F.size(F.filter(rings, lambda other: (other != ring) & inside(ring[0], other)))
        return F.when((ring_area(ring) < 0) != (around % 2 == 1), F.reverse(ring)).otherwise(ring)

    return F.transform(rings, turned)


def resize_nearest(mask: DataFrame, tiles: DataFrame, out_h: int, out_w: int, keys: list[str] = TILE) -> DataFrame:
    """Mask on another grid shape: an output cell takes the input cell under its centre."""
    shape = tiles.select(*keys, "height", "width")
    small = shape.withColumn("_y", F.explode(F.sequence(F.lit(0), F.lit(out_h - 1))))
    small = small.withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(out_w - 1))))
    source = small.select(*keys, "_y", "_x",
                          F.expr(f"cast((2 * _y + 1) * height div {2 * out_h} as int)").alias("y"),
                          F.expr(f"cast((2 * _x + 1) * width div {2 * out_w} as int)").alias("x"))
    return (source.join(mask.select(*keys, "y", "x"), [*keys, "y", "x"], "left_semi")
            .select(*keys, F.col("_y").alias("y"), F.col("_x").alias("x")))


def raster_shape(bounds: DataFrame, res: float) -> DataFrame:
    """Grid of a bounds table (left, bottom, right, top): ceil(extent / res)."""
    if res <= 0:
        raise ValueError("pixel size must be positive")
    return bounds.select(
        "*", F.lit(float(res)).alias("px"),
        F.ceil((F.col("right") - F.col("left")) / F.lit(float(res))).cast("int").alias("width"),
        F.ceil((F.col("top") - F.col("bottom")) / F.lit(float(res))).cast("int").alias("height"))


def build_raster(geoms: DataFrame, bounds: DataFrame, res: float, bucket: float, keys: list[str] = TILE) -> DataFrame:
    """Burn geometries by cell centre on grids derived from bounds."""
    if geoms.isEmpty():
        raise ValueError("no geometry to rasterise")
    return rasterize(geoms, raster_shape(bounds, res), False, bucket, keys)


def reproject(df: DataFrame, x: str, y: str, src: str, dst: str) -> DataFrame:
    """Closed-form spherical Mercator between EPSG:4326 and EPSG:3857; other pairs are rejected."""
    if src == dst:
        return df
    if (src, dst) == ("EPSG:4326", "EPSG:3857"):
        fx, fy = scores.mercator_x, scores.mercator_y
    elif (src, dst) == ("EPSG:3857", "EPSG:4326"):
        fx, fy = scores.inverse_mercator_lon, scores.inverse_mercator_lat
    else:
        raise ValueError(f"no closed form from {src} to {dst}")
    return df.withColumn(x, fx(F.col(x))).withColumn(y, fy(F.col(y)))


# ---- mosaics -------------------------------------------------------------------------------------------------

def mosaic_profile(tiles: DataFrame) -> DataFrame:
    """One row: common grid of all tiles."""
    b = tile_boxes(tiles)
    return b.agg(
        F.min("min_x").alias("left"), F.max("max_y").alias("top"), F.min("px").alias("px"),
        F.max("max_x").alias("right"), F.min("min_y").alias("bottom"), F.min("crs").alias("crs"),
    ).select(
        "left", "top", "px", "crs",
        F.rint((F.col("right") - F.col("left")) / F.col("px")).cast("int").alias("width"),
        F.rint((F.col("top") - F.col("bottom")) / F.col("px")).cast("int").alias("height"))


def mosaic_violations(tiles: DataFrame, profile: DataFrame, tol: float = 1e-6, keys: list[str] = TILE) -> DataFrame:
    """Tiles that do not fit the grid, with the reason; the profile is one row."""
    p = F.broadcast(profile.select(F.col("left").alias("_l"), F.col("top").alias("_t"), F.col("px").alias("_p"), F.col("crs").alias("_c"),
                                   F.col("width").alias("_w"), F.col("height").alias("_h")))
    row, col = (F.col("_t") - F.col("top")) / F.col("_p"), (F.col("left") - F.col("_l")) / F.col("_p")
    off = F.greatest(F.abs(row - F.rint(row)), F.abs(col - F.rint(col)))
    reason = (F.when(F.col("crs") != F.col("_c"), "crs").when((F.col("rot_b") != 0) | (F.col("rot_d") != 0), "rotation")
              .when(F.abs(F.col("px") - F.col("_p")) > tol, "pixel_size").when(off > tol, "offset")
              .when((row < -tol) | (col < -tol) | (row + F.col("height") > F.col("_h") + tol)
                    | (col + F.col("width") > F.col("_w") + tol), "bounds"))
    return tiles.join(p).withColumn("reason", reason).filter("reason is not null").select(*keys, "reason")


def mosaic_offsets(tiles: DataFrame, profile: DataFrame, keys: list[str] = TILE) -> DataFrame:
    """Integer row and column of each tile in the mosaic, and whether it fits inside."""
    p = F.broadcast(profile.select(F.col("left").alias("_l"), F.col("top").alias("_t"), F.col("px").alias("_p"),
                                   F.col("width").alias("_w"), F.col("height").alias("_h")))
    out = tiles.join(p).select(
        *keys, "height", "width", F.rint((F.col("_t") - F.col("top")) / F.col("_p")).cast("int").alias("row_off"),
        F.rint((F.col("left") - F.col("_l")) / F.col("_p")).cast("int").alias("col_off"), "_w", "_h")
    fits = ((F.col("row_off") >= 0) & (F.col("col_off") >= 0) & (F.col("row_off") + F.col("height") <= F.col("_h"))
            & (F.col("col_off") + F.col("width") <= F.col("_w")))
    return out.withColumn("fits", fits).drop("_w", "_h")


def profile_mismatches(a: DataFrame, b: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Fields in which two one-row profiles differ; grid numbers within a tolerance."""
    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(name)) for c in ("crs", "width", "height", "left", "top", "px")]
        return df.select(F.explode(F.array(*pairs)).alias("_f")).select("_f.*")

    both = long(a, "a").join(long(b, "b"), "field", "full")
    near = F.when(F.col("field").isin("left", "top", "px"),
                  F.abs(F.expr("try_cast(a as double)") - F.expr("try_cast(b as double)")) <= tol)
    same = F.coalesce(near, F.col("a").eqNullSafe(F.col("b")))
    return both.filter(~same).select("field")


def place_on_mosaic(mask: DataFrame, offsets: DataFrame, variant: str | None = None, keys: list[str] = TILE) -> DataFrame:
    """Mask cells in mosaic coordinates (variant, gy, gx, v)."""
    placed = mask.join(offsets.select(*keys, "row_off", "col_off"), keys)
    name = F.col("variant") if variant is None else F.lit(variant)
    return placed.select(name.alias("variant"), (F.col("y") + F.col("row_off")).cast("int").alias("gy"),
                         (F.col("x") + F.col("col_off")).cast("int").alias("gx"), F.lit(1).alias("v"))


def merge_mosaics(mosaics: DataFrame) -> DataFrame:
    """OR of mosaics per variant; a variant without a source gives no rows."""
    return mosaics.groupBy("variant", "gy", "gx").agg(F.max("v").alias("v"))


BANDS, MARKS = ("r", "g", "b", "score"), ("label", "gt", "buffer", "road")
#: Dense cells that are laid out at a time.
_LAID = 1 << 20


def _laid_rows(keys: list[str]):
    """Dense cells of rows: records of a (tile, row) are its width (kind 0), image cells (1) and cells of each mark (2 and on), in this order."""
    kept = [*keys, "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole_groups(batches, kept):
            kind, x = ints(table, "kind"), ints(table, "x")
            first = np.flatnonzero(np.diff(number, prepend=-1))
            width = np.where(kind[first] == 0, x[first], 0)  # a row outside its tile has no width, and no cells
            ends = np.cumsum(width)
            bands = {c: table.column(c).to_numpy() for c in BANDS}
            at = 0
            while at < len(first):
                # whole rows, of about as many dense cells as are laid out at a time
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _LAID, side="right")))
                a, b = int(first[at]), int(first[to]) if to < len(first) else len(kind)
                w, base = width[at:to], np.cumsum(width[at:to]) - width[at:to]
                group = number[a:b] - number[a]
                inside = (kind[a:b] > 0) & (x[a:b] >= 0) & (x[a:b] < w[group])
                place, total = base[group] + x[a:b], int(w.sum())
                columns = {}
                for c, v in bands.items():
                    hit = inside & (kind[a:b] == 1) & (v[a:b] == v[a:b])  # not null
                    low = np.full(total, -np.inf)
                    np.maximum.at(low, place[hit], v[a:b][hit].astype(np.float64))
                    low[np.isneginf(low)] = 0
                    columns[c] = low if c == "score" else low.astype(np.int32)
                for k, c in enumerate(MARKS, 2):
                    columns[c] = np.zeros(total, bool)
                    columns[c][place[inside & (kind[a:b] == k)]] = True
                rows = table.select(kept).take(pa.array(np.repeat(first[at:to], w)))
                yield from with_columns(rows, kept, x=(np.arange(total) - np.repeat(base, w)).astype(np.int32), **columns)
                at = to

    return run


def tile_context(image: DataFrame, label: DataFrame, gt: DataFrame, buffer: DataFrame, roads: DataFrame,
                 tiles: DataFrame, clip_gt: bool = True, keys: list[str] = TILE) -> DataFrame:
    """One dense table per tile: image, label, ground truth, buffer, roads and the ground truth used for evaluation.

    All layers meet once, by (tile, row), as the sparse cells that they are, with one record for each row of a tile; dense cells are laid out after that shuffle. Of
    repeated image cells each band's largest value counts.
    """
    def layer(df: DataFrame, kind: int, x: str = "x") -> DataFrame:
        return df.select(*keys, F.col("y").cast("int").alias("y"), F.col(x).cast("int").alias("x"), F.lit(kind).cast("tinyint").alias("kind"),
                         *[(F.col(c) if kind == 1 else F.lit(None)).cast("double" if c == "score" else "int").alias(c) for c in BANDS])

    rows = tiles.filter("height > 0 and width > 0").select(*keys, "width", F.explode(F.sequence(F.lit(0), (F.col("height") - 1).cast("int"))).alias("y"))
    stacked = layer(rows, 0, "width").unionByName(layer(image, 1))
    for kind, df in enumerate((label, gt, buffer, roads), 2):
        stacked = stacked.unionByName(layer(df, kind))
    dealt = stacked.repartition(*keys, "y").sortWithinPartitions(*keys, "y", "kind")
    schema = ddl(stacked, [*keys, "y"]) + ", x int, r int, g int, b int, score double, " + ", ".join(f"{m} boolean" for m in MARKS)
    out = dealt.mapInArrow(_laid_rows(keys), schema)
    used = F.col("gt") & F.col("buffer") if clip_gt else F.col("gt")
    return out.withColumn("gt_eval", used)


def buffer_cells(buffer_m: Column, pixel_m: Column) -> Column:
    """Buffer radius in cells, rounding halves to even."""
    return F.bround(buffer_m / pixel_m).cast("int")


def workload(ctx: DataFrame, tiles: DataFrame, ps: int, keys: list[str] = TILE) -> DataFrame:
    """Counts and coverage per tile and the number of whole patches."""
    agg = ctx.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cells"),
        *[F.sum(F.col(m).cast("bigint")).alias(f"{m}_cells") for m in ("label", "gt", "buffer", "road")],
        *[F.avg(F.col(m).cast("double")).alias(f"{m}_ratio") for m in ("label", "buffer", "road")])
    return with_dims(agg, tiles, keys).withColumn(
        "patch_rows", F.expr(f"cast((height div {ps}) * (width div {ps}) as bigint)")).drop("height", "width")

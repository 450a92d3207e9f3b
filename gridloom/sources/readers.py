"""Readers: cell and geometry tables, label rasters on tile grids, tile lists, span and done logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tiling import TILE

SPAN_SCHEMA = ("duration_s double, extra map<string,string>, image_id string, kind string, phase string, run_id string, "
               "stage string, substage string, tile string, ts string")
DONE_SCHEMA = "tile_path string, image_id string, status string, timestamp string"


def raster_cells(source: DataFrame, bands: tuple[str, str, str] = ("r", "g", "b"), keys: list[str] = TILE) -> DataFrame:
    """Cells with the first three bands as r, g, b; other bands are never read."""
    return source.select(*keys, "y", "x", *[F.col(b).alias(n) for b, n in zip(bands, "rgb")])


def read_cells(spark: SparkSession, path: str, bands: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    return raster_cells(spark.read.parquet(path), bands)


def downsample(cells: DataFrame, tiles: DataFrame, f: int, how: str = "bilinear", keys: list[str] = TILE) -> DataFrame:
    """Integer downsample to (h div f, w div f): box mean of each output cell, or its centre cell."""
    from ..operators.tiling import with_dims

    shaped = with_dims(cells, tiles, keys).withColumn("_oh", F.expr(f"height div {f}")).withColumn("_ow", F.expr(f"width div {f}"))
    if how == "nearest":
        oy, ox = F.expr("cast(y * _oh div height as int)"), F.expr("cast(x * _ow div width as int)")
        centre = (F.col("y") == F.expr("(2 * (y * _oh div height) + 1) * height div (2 * _oh)")) & (
            F.col("x") == F.expr("(2 * (x * _ow div width) + 1) * width div (2 * _ow)"))
        return shaped.filter("_oh > 0 and _ow > 0").filter(centre).select(*keys, oy.alias("y"), ox.alias("x"), "r", "g", "b")
    return (shaped.filter("_oh > 0 and _ow > 0")
            .groupBy(*keys, F.expr("cast(y * _oh div height as int)").alias("y"), F.expr("cast(x * _ow div width as int)").alias("x"))
            .agg(*[F.avg(c).alias(c) for c in "rgb"]))


def downsample_tiles(tiles: DataFrame, f: int) -> DataFrame:
    """Tile grid after the downsample; the cell size grows by width / out_width."""
    return (tiles.withColumn("px", F.col("px") * F.col("width") / F.expr(f"width div {f}"))
            .withColumn("height", F.expr(f"cast(height div {f} as int)")).withColumn("width", F.expr(f"cast(width div {f} as int)")))


def labels_on_grid(labels: DataFrame, grid: dict, tiles: DataFrame, fill: int = 0, keys: list[str] = TILE,
                   to_label: tuple[str, str] | None = None) -> DataFrame:
    """Nearest label value on every tile cell: cell centre -> source index by affine arithmetic, then an equi-join.

    `grid` = {left, top, px, height, width}. `to_label` = (tile crs, label crs) reprojects the centres first.
    """
    from ..operators.spatial import reproject
    from ..operators.tiling import dense_cells

    pos = dense_cells(tiles, keys).join(tiles.select(*keys, "left", "top", "px"), keys).select(
        *keys, "y", "x", (F.col("left") + (F.col("x") + 0.5) * F.col("px")).alias("_cx"), (F.col("top") - (F.col("y") + 0.5) * F.col("px")).alias("_cy"))
    if to_label:
        pos = reproject(pos, "_cx", "_cy", *to_label)
    asked = pos.select(
        *keys, "y", "x", F.floor((F.lit(float(grid["top"])) - F.col("_cy")) / F.lit(float(grid["px"]))).cast("int").alias("src_row"),
        F.floor((F.col("_cx") - F.lit(float(grid["left"]))) / F.lit(float(grid["px"]))).cast("int").alias("src_col"))
    return (asked.join(labels.select("src_row", "src_col", "v"), ["src_row", "src_col"], "left")
            .select(*keys, "y", "x", F.coalesce("v", F.lit(fill)).alias("v")))


def geometries(source: DataFrame) -> DataFrame:
    """Geometry rows; null and empty geometries are skipped."""
    return source.filter("rings is not null and size(rings) > 0 and size(rings[0]) > 0")


def rectangle_rings(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """One closed ring of a rectangle."""
    def pt(a: Column, b: Column) -> Column:
        return F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))

    return F.array(F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1)))


def list_tiles(spark: SparkSession, directory: str, glob: str = "*.tif") -> DataFrame:
    """Files right inside a folder that match a pattern, in path order; contents are not read. A missing folder is an error.

    Local paths come back plain, without a scheme, as list files and done logs have them.
    """
    # the file system itself says how deep the folder lies: with its scheme, absolute and without // or /./
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    inner = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, glob)
    if not list(fs.globStatus(inner) or []):
        fs.listStatus(path)  # raises if there is no such folder
        return spark.createDataFrame([], "path string, length long, mtime timestamp")
    # matched entries of this one level are listed, never the tree below
    found = spark.read.format("binaryFile").load(inner.toString())
    plain = found.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", F.col("modificationTime").alias("mtime"))
    whole = fs.makeQualified(path).toUri().getPath()
    inside = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    depth = len(_levels(whole)) + 1
    return plain.filter(F.size(F.split(inside, "/")) - 1 == depth).orderBy("path")


def _levels(path: str) -> list[str]:
    """Folders of an absolute path, without empty and `.` ones."""
    return [x for x in path.split("/") if x not in ("", ".")]


def read_tile_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("path")).filter("path <> ''")


def resolve_tiles(spark: SparkSession, tiles_file: str | None = None, directory: str | None = None, glob: str = "*.tif",
                  explicit: DataFrame | None = None, legacy: DataFrame | None = None, label_filter=None) -> DataFrame:
    """Tiles to infer: list file (unfiltered), else folder with pattern, else explicit list, else legacy list, all three label-filtered."""
    if tiles_file:
        return read_tile_list(spark, tiles_file).select("path", F.lit("file").alias("origin"))
    if directory:
        found = list_tiles(spark, directory, glob).select("path")
        return (label_filter(found) if label_filter else found).select("path", F.lit("folder").alias("origin"))
    for df, origin in ((explicit, "explicit"), (legacy, "legacy")):
        if df is not None:
            return (label_filter(df) if label_filter else df).select("path", F.lit(origin).alias("origin"))
    raise ValueError("no tile source configured")


def parse_spans(lines: DataFrame, column: str = "value") -> DataFrame:
    """Span rows from JSON lines; lines that are not JSON objects are dropped, missing durations are 0 and missing extras empty."""
    text = F.trim(column)
    # durations are read as text, so that a quoted number counts as a number
    obj = F.from_json(text, SPAN_SCHEMA.replace("duration_s double", "duration_s string"), {"mode": "PERMISSIVE"})
    # a malformed line parses to a struct of nulls; json_object_keys tells it from an empty object
    return (lines.filter(text.startswith("{")).filter(F.json_object_keys(text).isNotNull()).select(obj.alias("_s")).select("_s.*")
            .withColumn("duration_s", F.coalesce(F.col("duration_s").try_cast("double"), F.lit(0.0)))
            .withColumn("kind", F.coalesce("kind", F.lit("")))
            .withColumn("extra", F.coalesce("extra", F.create_map().cast("map<string,string>"))))


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    return parse_spans(spark.read.text(path))


def finished(log: DataFrame) -> DataFrame:
    """Distinct paths with status done."""
    return log.filter("status = 'done' and tile_path is not null and tile_path <> ''").select("tile_path").distinct()


def read_done(spark: SparkSession, path: str) -> DataFrame:
    return finished(spark.read.schema(DONE_SCHEMA).option("mode", "DROPMALFORMED").json(path))

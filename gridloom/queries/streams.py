"""Incremental queries over file streams of the shared tables; the final state equals the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spatial
from ..plans.scratch import cut, new_path
from ..sources import stores
from ..streaming import live
from . import data
from .data import query, r6, tiles
from .metrics import STAGE_ROWS, stages
from .sources import UNION


def as_stream(df, name, batches=3, by=()):
    """Write rows as files (rows of one `by` together) and read them back as a stream with one file per trigger step."""
    path = new_path(df.sparkSession, name)
    df.repartition(batches, *by).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def live_union(spark, d):
    """Mosaic and done log of a stream of mask cells with a marker row for each tile, of which some have no cell."""
    t = tiles(spark, d)
    offsets = cut(spatial.mosaic_offsets(t, spatial.mosaic_profile(t)), "offsets")
    masks = data.mask(spark, d, "label").unionByName(data.mask(spark, d, "gt")).withColumn("variant", F.lit("raw"))
    marks = t.select("tile_id", F.lit(None).cast("int").alias("y"), F.lit(None).cast("int").alias("x"), F.lit("raw").alias("variant"))
    src = as_stream(masks.unionByName(marks).join(t.select("tile_id", F.col("path").alias("tile_path")), "tile_id"), "masks-in", 2, ["tile_id"])
    mosaic, done = new_path(spark, "live-union"), new_path(spark, "live-done")
    live.stream_union(src, offsets, mosaic, done, new_path(spark, "live-progress"), new_path(spark, "ck"), ["tile_id"]).awaitTermination()
    return stores.read_mosaic(spark, mosaic), spark.read.parquet(done)


@query("STR-01", UNION)
def _(spark, d):
    return live_union(spark, d)[0].select("variant", "gy", "gx", "v")


@query("STR-01-done", "SELECT path AS tile_path, 'done' AS status FROM tiles")
def _(spark, d):
    return live_union(spark, d)[1].select("tile_path", "status")


@query("STR-02", "SELECT DISTINCT tile_path FROM done_log WHERE status = 'done'")
def _(spark, d):
    out = new_path(spark, "done-out")
    live.stream_done(as_stream(data.done_log(spark, d), "done-in"), out, new_path(spark, "ck")).awaitTermination()
    return spark.read.parquet(out)


EVERY = 8


@query("STR-03", f"""WITH log AS (SELECT *, coalesce(tile IS NOT NULL AND position = MAX(position) OVER (PARTITION BY tile), false) AS final FROM
    (SELECT event_id AS position, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'validation' ELSE 'holdout_inference' END AS phase, event_type AS stage,
    CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) < 20 THEN NULL ELSE 's' || (CAST(json_extract_string(props, '$.k') AS INT) % 5) END AS substage,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'tile_' || user_id END AS tile, value AS duration_s FROM events)),
    marks AS (SELECT position AS p, row_number() OVER (ORDER BY position) AS tiles FROM log WHERE final)
    SELECT tiles, phase, stage, substage, COUNT(*) AS "count", ROUND(SUM(duration_s), 6) AS total_s, MIN(duration_s) AS min_s, MAX(duration_s) AS max_s
    FROM marks JOIN log ON position <= p WHERE tiles % {EVERY} = 0 GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    """The log in file order, cut into uneven batches; each tile ends with its last span."""
    log = cut(data.spans(spark, d, "event_id").withColumnRenamed("event_id", "position"), "log")
    named = log.filter("tile is not null")  # rows without a tile would meet in one task
    last = named.groupBy("tile").agg(F.max("position").alias("_p"))
    final = F.coalesce(F.col("position") == F.col("_p"), F.lit(False))
    log = named.join(last, "tile", "left").withColumn("final", final).drop("_p").unionByName(log.filter("tile is null").withColumn("final", F.lit(False)))
    log = cut(log, "log-final")
    top, path = log.agg(F.max("position")).first()[0] or 0, new_path(spark, "log-in")
    out, ck = new_path(spark, "summaries"), new_path(spark, "ck")
    for low, high in ((0, 0.2), (0.2, 0.9), (0.9, 2)):  # a run takes all files that have come, and goes on where the last one ended
        log.filter((F.col("position") >= top * low) & (F.col("position") < top * high)).write.mode("append").parquet(path)
        live.stream_tile_summaries(spark.readStream.schema(log.schema).parquet(path), EVERY, out, ck).awaitTermination()
    return live.tile_summaries(spark, out).select("tiles", *live.SPAN, "count", *r6("total_s"), "min_s", "max_s")


@query("STR-04", f"""SELECT stage, ROUND(SUM(iou * weight) / SUM(weight), 6) AS iou, ROUND(SUM(f1 * weight) / SUM(weight), 6) AS f1, COUNT(*) AS tiles FROM {STAGE_ROWS} WHERE weight > 0 GROUP BY 1""")
def _(spark, d):
    rows = stages(spark, d).select("tile_id", "stage", "iou", "f1", "weight", (F.col("weight") > 0).alias("gt_available"))
    out = new_path(spark, "metrics-out")
    live.stream_metrics(as_stream(rows, "metrics-in"), out, new_path(spark, "ck")).awaitTermination()
    w = F.col("w")
    return live.latest_snapshot(spark, out).select("stage", F.round(F.col("w_iou") / w, 6).alias("iou"), F.round(F.col("w_f1") / w, 6).alias("f1"), "tiles")

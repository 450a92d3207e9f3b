"""Incremental forms: rolling mosaics, completed tiles, live span and metric summaries, and summaries at every n-th tile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.spatial import place_on_mosaic
from ..plans.ordering import running_total
from ..plans.scratch import StepTable
from ..sources.stores import append_union, exists


def _run(writer, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_union(masks: DataFrame, offsets: DataFrame, mosaic: str, done_log: str, progress: str, checkpoint: str,
                 keys: list[str]) -> StreamingQuery:
    """OR mask cells (variant, keys, tile_path, y, x) into the mosaics, then log finished tiles, then record progress.

    A tile is finished when its marker arrives, a row with null y and x after its cells; a tile with an empty mask has the marker alone.
    The order is fixed and each step may be repeated: the OR is idempotent and the log is read through a distinct.
    """
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        held = StepTable(batch, "masks")
        append_union(place_on_mosaic(held.df.filter("y is not null"), offsets, keys=keys), mosaic)
        done = held.df.filter("y is null").select("tile_path").distinct().withColumn("status", F.lit("done")).withColumn("batch_id", F.lit(batch_id))
        done.write.mode("overwrite").parquet(f"{done_log}/batch={batch_id}")
        done.agg(F.count(F.lit(1)).alias("tiles")).write.mode("overwrite").parquet(f"{progress}/batch={batch_id}")
        held.drop()

    return _run(masks.writeStream.foreachBatch(one_batch), checkpoint)


def stream_done(log: DataFrame, out: str, checkpoint: str, watermark: tuple[str, str] | None = None) -> StreamingQuery:
    """Unique completed tiles of an append-only log. State is one path per tile; with (column, delay) it is bounded by time."""
    rows = log.filter("status = 'done' and tile_path is not null and tile_path <> ''")
    if watermark:
        unique = rows.withWatermark(*watermark).dropDuplicatesWithinWatermark(["tile_path"]).select("tile_path")
    else:
        unique = rows.select("tile_path").dropDuplicates(["tile_path"])
    return _run(unique.writeStream.outputMode("append").format("parquet").option("path", out), checkpoint)


def _snapshot(out: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/snapshot={batch_id}")

    return write


def stream_spans(spans: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Running span aggregates per (phase, stage, substage), one snapshot per batch."""
    d = F.col("duration_s")
    agg = spans.groupBy("phase", "stage", "substage").agg(
        F.count(F.lit(1)).alias("count"), F.sum(d).alias("total_s"), F.min(d).alias("min_s"), F.max(d).alias("max_s"))
    return _run(agg.writeStream.outputMode("complete").foreachBatch(_snapshot(out)), checkpoint)


SPAN = ["phase", "stage", "substage"]


def stream_tile_summaries(log: DataFrame, every: int, out: str, checkpoint: str, position: str = "position", final: str = "final") -> StreamingQuery:
    """A summary of all spans so far at every `every`-th finished tile, wherever batches begin and end.

    `log` has SPAN, duration_s, a rising `position`, and `final` on the row that finishes a tile. A row belongs to the first summary whose last tile it does not
    follow. What is kept is the number of finished tiles of each batch and the sums of its rows by span and summary; both are written under the batch's own number, so
    a batch that is repeated after a restart changes nothing.
    """
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark, held = batch.sparkSession, StepTable(batch, "log")
        done = held.df.filter(final).agg(F.count(F.lit(1)).alias("tiles"))
        done.write.mode("overwrite").parquet(f"{out}/done/batch={batch_id}")
        counts = spark.read.option("basePath", f"{out}/done").parquet(f"{out}/done")
        base, now = (counts.filter(F.col("batch") <= b).agg(F.coalesce(F.sum("tiles"), F.lit(0))).first()[0] for b in (batch_id - 1, batch_id))
        is_last, d = F.col(final).cast("int"), F.col("duration_s")
        numbered = running_total(held.df, [F.col(position)], "_done", is_last)
        summary = (F.floor((F.col("_done") - is_last + F.lit(base)) / every) + 1).alias("summary")
        numbered.groupBy(*SPAN, summary).agg(F.count(F.lit(1)).alias("count"), F.sum(d).alias("total_s"), F.min(d).alias("min_s"), F.max(d).alias("max_s")).write.mode("overwrite").parquet(f"{out}/parts/batch={batch_id}")
        first, last = base // every + 1, now // every
        if first <= last:
            parts = spark.read.option("basePath", f"{out}/parts").parquet(f"{out}/parts").filter((F.col("batch") <= batch_id) & (F.col("summary") <= last))
            sums = {"count": F.sum, "total_s": F.sum, "min_s": F.min, "max_s": F.max}
            held_by = parts.groupBy(*SPAN, F.greatest("summary", F.lit(first)).alias("summary")).agg(*[f(c).alias(c) for c, f in sums.items()])
            # running sums of a span, each repeated up to the span's next row: as many rows as the summaries have
            line = Window.partitionBy(*SPAN).orderBy("summary")
            running = held_by.select(*SPAN, "summary", *[f(c).over(line.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c, f in sums.items()],
                                     (F.coalesce(F.lead("summary").over(line), F.lit(last + 1)) - 1).alias("_to"))
            told = running.withColumn("_m", F.explode(F.sequence("summary", "_to"))).select((F.col("_m") * every).alias("tiles"), *SPAN, *sums)
            told.write.mode("overwrite").parquet(f"{out}/summaries/batch={batch_id}")
        held.drop()

    return _run(log.writeStream.foreachBatch(one_batch), checkpoint)


def tile_summaries(spark, out: str) -> DataFrame:
    """(tiles, SPAN, count, total_s, min_s, max_s) of every summary written so far."""
    schema = f"tiles bigint, {', '.join(f'{c} string' for c in SPAN)}, `count` bigint, total_s double, min_s double, max_s double"
    if not exists(spark, f"{out}/summaries"):
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", f"{out}/summaries").parquet(f"{out}/summaries").drop("batch")


def stream_metrics(metrics: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Running weighted sums per stage over tiles with ground truth; the mean is taken when the snapshot is read."""
    rows = metrics.filter("gt_available")
    agg = rows.groupBy("stage").agg(
        F.sum("weight").alias("w"), F.sum(F.col("iou") * F.col("weight")).alias("w_iou"), F.sum(F.col("f1") * F.col("weight")).alias("w_f1"),
        F.count(F.lit(1)).alias("tiles"))
    return _run(agg.writeStream.outputMode("complete").foreachBatch(_snapshot(out)), checkpoint)


def latest_snapshot(spark, out: str) -> DataFrame:
    """Rows of the newest snapshot (complete mode rewrites all groups each time)."""
    every = spark.read.option("basePath", out).parquet(f"{out}/snapshot=*")
    newest = every.agg(F.max("snapshot").alias("snapshot"))
    return every.join(F.broadcast(newest), "snapshot", "left_semi").drop("snapshot")  # one row

"""Catalog, split, fold and batch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog
from .data import buffer, done_log, geoms, mask, part_catalog, query, tiles
from .sources import GRID, label_raster

KEEP = """EXISTS (SELECT 1 FROM part WHERE p_size % 3 > 0 AND p_partkey % 50 * 2 + 1 >= "left" AND p_partkey % 50 * 2 + 1 < "left" + width
    AND -(p_partkey // 50 * 2 + 1) > top - height AND -(p_partkey // 50 * 2 + 1) <= top)"""


def kept(spark, d, t):
    return catalog.tiles_with_label(t, label_raster(spark, d), GRID)


@query("CAT-01", f"SELECT tile_id, {KEEP} AS keep FROM tiles")
def _(spark, d):
    return kept(spark, d, tiles(spark, d)).select("tile_id", "keep")


@query("CAT-02", f"SELECT tile_id, {KEEP} AS keep, width <> 31 AS cached FROM tiles")
def _(spark, d):
    t = tiles(spark, d).withColumn("mtime", F.lit(100)).withColumn("size", F.col("width") * 10)
    cache = (kept(spark, d, tiles(spark, d)).select("path", F.lit(100).alias("mtime"), F.when(F.col("width") == 31, 0).otherwise(F.col("width") * 10).alias("size"),
                                                    F.lit("sig").alias("raster_sig"), "keep"))
    return catalog.with_cached_decisions(t, cache, lambda missing: kept(spark, d, missing), "sig").select("tile_id", "keep", "cached")


TOUCH = """EXISTS (SELECT 1 FROM rects r WHERE layer = 'gt' AND r.tile_id % 10 * 24 + x0 + 0.25 <= "left" + width AND r.tile_id % 10 * 24 + x0 + w + 0.25 >= "left"
    AND r.tile_id // 10 * -24 - y0 - 0.25 >= top - t.height AND r.tile_id // 10 * -24 - y0 - h - 0.25 <= top)"""


@query("CAT-03", f"SELECT tile_id FROM tiles t WHERE {TOUCH}")
def _(spark, d):
    return catalog.tiles_touching(tiles(spark, d), geoms(spark, d).filter("layer = 'gt'").drop("tile_id"), 32.0).select("tile_id")


@query("CAT-04", """SELECT t.tile_id, COUNT(b.tile_id) AS gt_cells FROM tiles t LEFT JOIN gt_mask q ON q.tile_id = t.tile_id
    LEFT JOIN buffer_mask b ON b.tile_id = q.tile_id AND b.y = q.y AND b.x = q.x GROUP BY 1""")
def _(spark, d):
    return catalog.effective_gt(tiles(spark, d), mask(spark, d, "gt"), buffer(spark, d))


@query("CAT-05", f"""SELECT t.tile_id, CAST(n AS BIGINT) AS gt_cells, CASE WHEN {TOUCH} AND n > 0 THEN 'train' ELSE 'inference' END AS split FROM tiles t JOIN
    (SELECT t.tile_id, COUNT(b.tile_id) AS n FROM tiles t LEFT JOIN gt_mask q ON q.tile_id = t.tile_id
    LEFT JOIN buffer_mask b ON b.tile_id = q.tile_id AND b.y = q.y AND b.x = q.x GROUP BY 1) e ON e.tile_id = t.tile_id WHERE {KEEP}""")
def _(spark, d):
    t = tiles(spark, d)
    touching = catalog.tiles_touching(t, geoms(spark, d).filter("layer = 'gt'").drop("tile_id"), 32.0)
    effective = catalog.effective_gt(t, mask(spark, d, "gt"), buffer(spark, d))
    return catalog.split_gt_tiles(t, kept(spark, d, t), touching, effective).select("tile_id", "gt_cells", "split")


@query("CAT-06", """SELECT path, CASE WHEN row_number() OVER (ORDER BY md5(path || '|42'), path) <= round_even(COUNT(*) OVER () * CAST(0.3 AS DOUBLE), 0) THEN 'val' ELSE 'train' END AS "role"
    FROM part_catalog""")
def _(spark, d):
    return catalog.train_val_split(part_catalog(spark, d), 0.3, 42)


PENDING = """(SELECT path, row_number() OVER (ORDER BY path) AS idx, COUNT(*) OVER () AS total FROM part_catalog
    WHERE path NOT IN (SELECT tile_path FROM done_log WHERE status = 'done'))"""


def pending(spark, d):
    return catalog.pending_tiles(part_catalog(spark, d), done_log(spark, d).filter("status = 'done'"))


@query("CAT-07", f"SELECT path, idx, total FROM {PENDING}")
def _(spark, d):
    return pending(spark, d).select("path", "idx", "total")


@query("CAT-08", f"SELECT path, (idx - 1) % 10 = 0 AS flag FROM {PENDING}")
def _(spark, d):
    return catalog.every_nth(pending(spark, d), 10).select("path", "flag")


@query("CAT-09", "SELECT path, (row_number() OVER (ORDER BY path) - 1) % 7 AS shard FROM part_catalog")
def _(spark, d):
    return catalog.round_robin(part_catalog(spark, d), 7).select("path", "shard")


@query("CAT-10", "SELECT path, (row_number() OVER (ORDER BY path) - 1) // 100 AS batch FROM part_catalog")
def _(spark, d):
    return catalog.contiguous_batches(part_catalog(spark, d), 100).select("path", "batch")


@query("CAT-11", """SELECT k AS shard, COUNT(s) AS n_tiles FROM range(9) r(k) LEFT JOIN (SELECT (row_number() OVER (ORDER BY path) - 1) % 7 AS s FROM part_catalog) a ON a.s = k GROUP BY 1""")
def _(spark, d):
    return catalog.shard_manifest(catalog.round_robin(part_catalog(spark, d), 7), 9)


@query("CAT-12", """WITH b AS (SELECT path, (row_number() OVER (ORDER BY path) - 1) // 20 AS batch FROM part_catalog),
    p AS (SELECT batch, COUNT(*) AS expected_tiles, COUNT(*) FILTER (path IN (SELECT tile_path FROM done_log WHERE status = 'done')) AS done_tiles FROM b GROUP BY 1)
    SELECT batch, expected_tiles, done_tiles, batch % 4 AS retry_count, done_tiles >= expected_tiles AS complete, done_tiles < expected_tiles AND batch % 4 < 2 AS retryable,
    (SELECT bool_and(done_tiles >= expected_tiles) FROM p) AS ready FROM p""")
def _(spark, d):
    batches = catalog.contiguous_batches(part_catalog(spark, d), 20).select("path", "batch")
    log = done_log(spark, d).join(batches.withColumnRenamed("path", "tile_path"), "tile_path")
    retries = batches.select("batch").distinct().withColumn("retry_count", F.col("batch") % 4)
    progress = catalog.batch_progress(batches, log, retries, 2)
    return progress.join(F.broadcast(catalog.ready_to_merge(progress)))


@query("CAT-13", """WITH t AS (SELECT COUNT(*) AS n FROM tiles), v AS (SELECT f AS fold, (f + j) % n AS idx FROM t, range(n) a(f), range(3) b(j)),
    m AS (SELECT f AS fold, i AS idx, EXISTS (SELECT 1 FROM v WHERE v.fold = f AND v.idx = i) AS val FROM t, range(n) a(f), range(n) b(i)),
    g AS (SELECT fold, idx, val, idx - row_number() OVER (PARTITION BY fold, val ORDER BY idx) AS grp FROM m)
    SELECT fold, CASE WHEN val THEN 'val' ELSE 'train' END AS "role", MIN(idx) AS from_idx, MAX(idx) AS to_idx FROM g GROUP BY fold, val, grp""")
def _(spark, d):
    return catalog.loo_folds(tiles(spark, d), 3)


@query("CAT-14", """WITH n AS (SELECT COUNT(*) AS n FROM tiles), p AS (SELECT tile_id, path, row_number() OVER (ORDER BY path) - 1 AS idx FROM tiles),
    e AS (SELECT p.path, p.idx, COUNT(b.tile_id) AS gt_cells FROM p LEFT JOIN gt_mask q ON q.tile_id = p.tile_id
    LEFT JOIN buffer_mask b ON b.tile_id = q.tile_id AND b.y = q.y AND b.x = q.x GROUP BY 1, 2)
    SELECT fold, CAST(SUM(gt_cells) AS BIGINT) AS gt_cells, CASE WHEN SUM(gt_cells) < 220 THEN 'low_gt' END AS reason, false AS reuse_val
    FROM (SELECT (idx - j + n) % n AS fold, gt_cells FROM e, n, range(3) b(j)) GROUP BY 1""")
def _(spark, d):
    t = tiles(spark, d)
    gt = t.select("tile_id", "path").join(catalog.effective_gt(t, mask(spark, d, "gt"), buffer(spark, d)), "tile_id")
    return catalog.apply_low_gt(catalog.fold_tiles(t, 3), gt, 220, "skip_fold", t.count(), 3)

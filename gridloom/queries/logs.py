"""Span-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spanlog
from .data import query, r6, spans

STATS = """CAST(COUNT(*) AS BIGINT) AS "count", MAX(duration_s) AS max_s, ROUND(AVG(duration_s), 6) AS mean_s, ROUND(MEDIAN(duration_s), 6) AS median_s, MIN(duration_s) AS min_s,
    list_sort(list(duration_s))[CAST(greatest(1, ceil(CAST(0.9 AS DOUBLE) * COUNT(*))) AS BIGINT)] AS p90_s, ROUND(SUM(duration_s), 6) AS total_s"""


def shown(df, *by):
    return df.select(*by, "count", "max_s", *r6("mean_s", "median_s"), "min_s", "p90_s", *r6("total_s"))


@query("LOG-01", """SELECT kind, phase, stage, substage, tile, duration_s FROM spans WHERE kind IN ('span', 'timer') AND phase = 'holdout_inference' AND tile IS NOT NULL
    AND contains(lower(stage || '::' || coalesce(substage, '')), 'click::s')""")
def _(spark, d):
    return spanlog.filter_spans(spans(spark, d), ["span", "timer"], "holdout_inference", False, "CLICK::s").drop("run_id")


@query("LOG-02", f"SELECT kind, {STATS} FROM spans GROUP BY 1")
def _(spark, d):
    return shown(spanlog.duration_stats(spans(spark, d), ["kind"]), "kind")


@query("LOG-03", f"SELECT stage, {STATS} FROM spans WHERE stage IS NOT NULL GROUP BY 1")
def _(spark, d):
    return shown(spanlog.by_stage(spans(spark, d)), "stage")


@query("LOG-04", f"SELECT stage, coalesce(substage, '<none>') AS substage, {STATS} FROM spans GROUP BY 1, 2")
def _(spark, d):
    return shown(spanlog.by_substage(spans(spark, d)), "stage", "substage")


@query("LOG-05", f"SELECT tile, {STATS} FROM spans WHERE tile IS NOT NULL GROUP BY 1")
def _(spark, d):
    return shown(spanlog.by_tile(spans(spark, d)), "tile")


@query("LOG-06", """WITH s AS (SELECT tile, coalesce(stage, '<none>') || '::' || coalesce(substage, '<none>') AS contributor, SUM(duration_s) AS duration_s
    FROM spans WHERE tile IS NOT NULL GROUP BY 1, 2), t AS (SELECT tile FROM (SELECT tile, SUM(duration_s) AS t FROM s GROUP BY 1) ORDER BY ROUND(t, 9) DESC, tile LIMIT 10)
    SELECT * FROM (SELECT tile, CAST(row_number() OVER (PARTITION BY tile ORDER BY ROUND(duration_s, 9) DESC, contributor) AS INT) AS "rank", contributor,
    ROUND(duration_s, 6) AS duration_s FROM s WHERE tile IN (SELECT tile FROM t)) WHERE "rank" <= 5""")
def _(spark, d):
    return spanlog.hottest(spans(spark, d), 10).select("tile", "rank", "contributor", *r6("duration_s"))


@query("LOG-07", """SELECT COUNT(*) AS row_count, COUNT(*) FILTER (phase IS NULL) AS null_phase_count, COUNT(*) FILTER (tile IS NULL) AS null_tile_count,
    COUNT(DISTINCT tile) AS tile_count, COUNT(DISTINCT run_id) AS run_count FROM spans""")
def _(spark, d):
    return spanlog.overview(spans(spark, d))


@query("LOG-07-counts", """SELECT 'kind' AS field, kind AS "value", COUNT(*) AS n FROM spans GROUP BY 2 UNION ALL
    SELECT 'phase', coalesce(phase, '<none>'), COUNT(*) FROM spans GROUP BY 2""")
def _(spark, d):
    return spanlog.value_counts(spans(spark, d))


@query("LOG-08", """WITH f AS (SELECT *, kind IN ('span', 'timer') AND coalesce(phase = 'holdout_inference', false) AND tile IS NOT NULL AS sel FROM spans)
    SELECT COUNT(*) FILTER (NOT sel) AS excluded_rows, COUNT(*) FILTER (NOT sel AND phase IS NULL) AS excluded_phase_null,
    COUNT(*) FILTER (NOT sel AND phase <> 'holdout_inference') AS excluded_other_phase, COUNT(*) FILTER (NOT sel AND tile IS NULL AND phase = 'holdout_inference') AS excluded_tile_null,
    COUNT(*) FILTER (sel) AS selected_rows, COUNT(*) FILTER (sel AND kind = 'timer') AS selected_timer_rows, COUNT(*) FILTER (sel AND kind = 'span') AS selected_span_rows FROM f""")
def _(spark, d):
    return spanlog.exclusions(spans(spark, d), ["span", "timer"], "holdout_inference", False)


@query("LOG-09", f"SELECT tile, {STATS} FROM spans WHERE tile IS NOT NULL AND stage = 'click' AND coalesce(substage, '<none>') = '<none>' GROUP BY 1")
def _(spark, d):
    return shown(spanlog.outlier_tiles(spans(spark, d), "click", "<none>"), "tile")


@query("LOG-10", f"""SELECT stage, substage, max_s, median_s FROM (SELECT stage, coalesce(substage, '<none>') AS substage, {STATS} FROM spans GROUP BY 1, 2)
    WHERE max_s >= greatest(CAST(60 AS DOUBLE), 5 * median_s) ORDER BY ROUND(total_s, 9) DESC, stage, substage LIMIT 1""")
def _(spark, d):
    return spanlog.outlier_warning(spanlog.by_substage(spans(spark, d))).select("stage", "substage", "max_s", *r6("median_s"))


@query("LOG-11", """SELECT phase, stage, substage, COUNT(*) AS "count", ROUND(SUM(duration_s), 6) AS total_s, MIN(duration_s) AS min_s, MAX(duration_s) AS max_s,
    ROUND(AVG(duration_s), 6) AS mean_s FROM spans GROUP BY 1, 2, 3""")
def _(spark, d):
    return spanlog.rolling_summary(spans(spark, d)).select("phase", "stage", "substage", "count", *r6("total_s"), "min_s", "max_s", *r6("mean_s"))


@query("LOG-11-top", """SELECT phase, stage, substage, ROUND(SUM(duration_s), 6) AS total_s, ROUND(AVG(duration_s), 6) AS mean_s FROM spans GROUP BY 1, 2, 3
    ORDER BY ROUND(SUM(duration_s), 9) DESC, coalesce(phase, ''), stage, coalesce(substage, '') LIMIT 5""")
def _(spark, d):
    return spanlog.top_by_total(spanlog.rolling_summary(spans(spark, d))).select("phase", "stage", "substage", *r6("total_s", "mean_s"))


@query("LOG-12", """SELECT ROUND(AVG(t), 6) AS mean_s, ROUND(MIN(t), 6) AS min_s, ROUND(MAX(t), 6) AS max_s, ROUND(MEDIAN(t), 6) AS median_s
    FROM (SELECT tile, SUM(duration_s) AS t FROM spans WHERE tile IS NOT NULL GROUP BY 1)""")
def _(spark, d):
    return spanlog.tile_total_stats(spans(spark, d)).select(*r6("mean_s", "min_s", "max_s", "median_s"))

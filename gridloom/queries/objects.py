"""Refinement and object-proposal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components, proposals, refine
from ..plans import chain
from ..plans.scratch import cut
from .data import CTES, RECURSIVE, buffer, context, mask, query, r6, scored, shape_sql, tiles

CELL = ["tile_id", "y", "x"]
CRF = refine.PairwiseConfig(prob_softness=0.15, trimap_band=0, pos_w=1.0, pos_xy_std=3.0, bilateral_w=2.0, bilateral_xy_std=8.0, bilateral_rgb_std=40.0, steps=3)
RULES = proposals.ProposalConfig(min_area_px=3, min_length_m=2.0, max_width_m=3.0, min_skeleton_ratio=0.5, min_pca_ratio=1.2, max_circularity=3.0, min_mean_score=0.3, max_road_overlap=0.5)

CTES.update({
    "candidates": """SELECT tile_id, y, x, score, road, CASE WHEN buffer THEN 'inside_buffer_auto' ELSE 'outside_evaluated' END AS zone FROM ctx WHERE score >= 0.4 AND NOT label""",
    "pro_seeds": """SELECT m.tile_id, m.zone, m.y, m.x FROM candidates m WHERE NOT EXISTS (SELECT 1 FROM candidates n WHERE n.tile_id = m.tile_id AND n.zone = m.zone
        AND ((n.y = m.y AND n.x = m.x - 1) OR (n.y = m.y - 1 AND n.x = m.x - 1) OR (n.y = m.y - 1 AND n.x = m.x) OR (n.y = m.y - 1 AND n.x = m.x + 1)))""",
    "pro_reach": """SELECT tile_id, zone, y AS sy, x AS sx, y, x FROM pro_seeds UNION SELECT p.tile_id, p.zone, p.sy, p.sx, n.y, n.x FROM pro_reach p
        CROSS JOIN (SELECT CAST(a AS INT) AS dy, CAST(b AS INT) AS dx FROM unnest(range(-1, 2)) u(a), unnest(range(-1, 2)) v(b) WHERE a <> 0 OR b <> 0) o
        JOIN candidates n ON n.tile_id = p.tile_id AND n.zone = p.zone AND n.y = p.y + o.dy AND n.x = p.x + o.dx""",
    "pro_cells": """SELECT c.*, r.root FROM candidates c JOIN (SELECT tile_id, zone, y, x, MIN(sy * 1000 + sx) AS root FROM pro_reach GROUP BY 1, 2, 3, 4) r
        ON r.tile_id = c.tile_id AND r.zone = c.zone AND r.y = c.y AND r.x = c.x""",
    "pro_basic": """SELECT tile_id, zone, CAST(root AS BIGINT) AS root, CAST(n AS DOUBLE) AS area_px, cy AS centroid_row, cx AS centroid_col, s AS mean_score, o AS road_overlap,
        CASE WHEN n < 2 THEN 1 ELSE greatest((a + d) / 2 + h, 1e-8) / greatest((a + d) / 2 - h, 1e-8) END AS pca_ratio FROM
        (SELECT *, SQRT((a - d) / 2 * (a - d) / 2 + b * b) AS h FROM (SELECT tile_id, zone, root, COUNT(*) AS n, AVG(y) AS cy, AVG(x) AS cx, AVG(score) AS s, AVG(road::INT) AS o,
        var_samp(y) AS a, var_samp(x) AS d, covar_samp(y, x) AS b FROM pro_cells GROUP BY 1, 2, 3))""",
})
RECURSIVE.add("pro_reach")


def root():
    return (F.shiftright("root", 31) * 1000 + F.col("root").bitwiseAND((1 << 31) - 1)).alias("root")


def candidate_cells(spark, d):
    ctx = context(spark, d)
    return proposals.candidates(ctx.filter("score >= 0.4"), mask(spark, d, "label"), buffer(spark, d))


def object_cells(spark, d):
    ctx = cut(context(spark, d), "context")
    cand = proposals.candidates(ctx.filter("score >= 0.4"), ctx.filter("label"), ctx.filter("buffer"))
    return proposals.objects(cand, 2).join(ctx.select(*CELL, "score", "road"), CELL)


@query("REF-01")
def _(spark, d):
    prepared = refine.unary(context(spark, d), CRF, 0.5)
    return refine.pairwise_refine(prepared, CRF).filter("mask").groupBy("tile_id").agg(F.count(F.lit(1)).alias("cells"), F.round(F.avg("p_fg"), 6).alias("p_fg"))


STREAM = """WITH RECURSIVE thr AS (SELECT tile_id, y, x FROM ctx WHERE score >= 0.35),
    med AS (SELECT a.tile_id, a.y, a.x, a.height, a.width FROM grid a CROSS JOIN (SELECT CAST(p AS INT) AS dy, CAST(q AS INT) AS dx FROM unnest(range(-1, 2)) u(p), unnest(range(-1, 2)) v(q)) o
        JOIN thr b ON b.tile_id = a.tile_id AND b.y = greatest(0, least(a.height - 1, a.y + dy)) AND b.x = greatest(0, least(a.width - 1, a.x + dx)) GROUP BY ALL HAVING COUNT(*) >= 5),
    clip AS ({clip}), bg AS (SELECT tile_id, y, x, height, width FROM grid ANTI JOIN clip USING (tile_id, y, x)),
    o AS (SELECT tile_id, y, x FROM bg WHERE y = 0 OR x = 0 OR y = height - 1 OR x = width - 1 UNION
        SELECT n.tile_id, n.y, n.x FROM o CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) s(dy, dx) JOIN bg n ON n.tile_id = o.tile_id AND n.y = o.y + dy AND n.x = o.x + dx),
    full_mask AS (SELECT tile_id, y, x FROM clip UNION ALL SELECT tile_id, y, x FROM bg ANTI JOIN o USING (tile_id, y, x))
    SELECT tile_id, y, x FROM full_mask {end}"""


@query("REF-02", STREAM.format(clip="SELECT tile_id, y, x FROM med SEMI JOIN buffer_mask USING (tile_id, y, x)", end="SEMI JOIN buffer_mask USING (tile_id, y, x)"))
def _(spark, d):
    return refine.stream_mask(scored(spark, d), F.col("score"), 0.35, tiles(spark, d), buffer(spark, d), True)


@query("REF-03")
def _(spark, d):
    cfg = chain.ChainConfig(threshold=0.4, crf=CRF, proposal=RULES, shadow_threshold=150.0)
    return chain.infer_tiles(context(spark, d), tiles(spark, d), cfg).groupBy("variant").agg(F.count(F.lit(1)).alias("cells"))


@query("REF-04", f"SELECT 'raw' AS variant, * FROM ({STREAM.format(clip='SELECT tile_id, y, x FROM med', end='')}) UNION ALL SELECT 'crf', * FROM ({STREAM.format(clip='SELECT tile_id, y, x FROM med SEMI JOIN buffer_mask USING (tile_id, y, x)', end='SEMI JOIN buffer_mask USING (tile_id, y, x)')})")
def _(spark, d):
    cfg = chain.ChainConfig(threshold=0.35, penalty=1.0)
    return chain.infer_tiles(context(spark, d), tiles(spark, d), cfg, preview=True)


@query("PRO-01", "SELECT tile_id, y, x, zone FROM candidates")
def _(spark, d):
    return candidate_cells(spark, d)


BASIC = ["centroid_row", "centroid_col", "mean_score", "road_overlap", "pca_ratio"]


@query("PRO-02", """SELECT tile_id, zone, root, area_px, ROUND(centroid_row, 6) AS centroid_row, ROUND(centroid_col, 6) AS centroid_col, ROUND(mean_score + 1e-10, 6) AS mean_score,
    ROUND(road_overlap, 6) AS road_overlap FROM pro_basic""")
def _(spark, d):
    out = proposals.basic_metrics(object_cells(spark, d), proposals.object_key())
    return out.withColumn("mean_score", F.col("mean_score") + 1e-10).select("tile_id", "zone", root(), "area_px", *r6(*BASIC[:4]))


@query("PRO-03", "SELECT tile_id, zone, root, ROUND(log10(pca_ratio), 6) AS pca_ratio_log10 FROM pro_basic")
def _(spark, d):
    """Ratios beyond one million are objects of one row or column: their size depends on the last bits of the smaller eigenvalue."""
    out = proposals.basic_metrics(object_cells(spark, d), proposals.object_key())
    return out.select("tile_id", "zone", root(), F.round(F.log10("pca_ratio"), 6).alias("pca_ratio_log10"))  # relative, so that straight objects count


@query("PRO-04", f"""WITH {shape_sql("(SELECT tile_id, CAST(root AS BIGINT) AS root, y, x FROM rooted8)", ["tile_id", "root"])}
    SELECT tile_id, root, perimeter_px, length_px, ROUND(circularity, 6) AS circularity, ROUND(mean_width_px, 6) AS mean_width_px, ROUND(skeleton_ratio, 6) AS skeleton_ratio FROM shape
    UNION ALL SELECT -1, -1, 0, 0, 0, 0, 0 FROM unfinished""")
def _(spark, d):
    out = proposals.shape_metrics(components.rooted_cells(mask(spark, d, "label"), 2), ["tile_id", "root"], 0.5)
    return out.select("tile_id", root(), "perimeter_px", "length_px", *r6("circularity", "mean_width_px", "skeleton_ratio"))


CHECK = """(SELECT *, area_px >= 3 AS min_area_px, pca_ratio >= 1.2 - 1e-9 AS min_pca_ratio, mean_score >= 0.3 - 1e-9 AS min_mean_score, road_overlap <= 0.5 + 1e-9 AS max_road_overlap FROM pro_basic)"""


def verdicts(spark, d):
    return proposals.evaluate(object_cells(spark, d), RULES, 1.0)


#: A measure within 1e-9 of its limit meets it (as in proposals.TIE): several pixel shapes have an elongation of exactly 1.2. Verdicts over all eight rules; a rule that needs a shape is false where none was measured.
VERDICT = f"""WITH {shape_sql("(SELECT c.tile_id, c.zone, CAST(c.root AS BIGINT) AS root, c.y, c.x FROM pro_cells c JOIN {check} k ON k.tile_id = c.tile_id AND k.zone = c.zone AND k.root = c.root WHERE c.zone = 'inside_buffer_auto' OR (min_area_px AND min_pca_ratio AND min_mean_score AND max_road_overlap))".format(check=CHECK), ["tile_id", "zone", "root"])},
    ruled AS (SELECT c.*, s.length_px, c.min_area_px AND c.min_pca_ratio AND c.min_mean_score AND c.max_road_overlap AND s.length_px IS NOT NULL AS ok,
        least(20, 3 + greatest(pca_ratio - 1.2, 0)) AS width, s.mean_width_px, s.skeleton_ratio, s.circularity FROM {CHECK} c LEFT JOIN shape s ON s.tile_id = c.tile_id AND s.zone = c.zone AND s.root = c.root),
    rules AS (SELECT *, coalesce(ok AND length_px >= 2 - 1e-9, false) AS min_length_m, coalesce(ok AND mean_width_px <= width + 1e-9, false) AS max_width_m, coalesce(ok AND skeleton_ratio >= 0.5 - 1e-9, false) AS min_skeleton_ratio,
        coalesce(ok AND circularity <= 3 + 1e-9, false) AS max_circularity FROM ruled),
    passed AS (SELECT *, min_area_px::INT + min_length_m::INT + max_width_m::INT + min_skeleton_ratio::INT + min_pca_ratio::INT + max_circularity::INT + min_mean_score::INT + max_road_overlap::INT AS n FROM rules),
    verdicts AS (SELECT *, zone = 'inside_buffer_auto' OR n = 8 AS accepted, CASE WHEN zone = 'inside_buffer_auto' THEN 1 ELSE n / 8 END AS acceptance_score,
        CASE WHEN zone = 'inside_buffer_auto' THEN '' ELSE concat_ws(',', CASE WHEN NOT min_area_px THEN 'min_area_px' END, CASE WHEN NOT min_length_m THEN 'min_length_m' END, CASE WHEN NOT max_width_m THEN 'max_width_m' END,
        CASE WHEN NOT min_skeleton_ratio THEN 'min_skeleton_ratio' END, CASE WHEN NOT min_pca_ratio THEN 'min_pca_ratio' END, CASE WHEN NOT max_circularity THEN 'max_circularity' END,
        CASE WHEN NOT min_mean_score THEN 'min_mean_score' END, CASE WHEN NOT max_road_overlap THEN 'max_road_overlap' END) END AS reject_reasons,
        row_number() OVER (PARTITION BY tile_id ORDER BY zone, root) AS component_id FROM passed)"""


@query("PRO-05", f"""{VERDICT} SELECT tile_id, zone, root, {', '.join(proposals.RULES)}, min_area_px AND min_pca_ratio AND min_mean_score AND max_road_overlap AS cheap_pass,
    ROUND(CASE WHEN ok AND zone = 'outside_evaluated' THEN width END, 4) AS allowed_width_m FROM rules""")
def _(spark, d):
    out = verdicts(spark, d)
    return out.select("tile_id", "zone", root(), *proposals.RULES, proposals.cheap_pass().alias("cheap_pass"), F.round("allowed_width_m", 4).alias("allowed_width_m"))


@query("PRO-06", f"""{VERDICT} SELECT tile_id, zone, root, CAST(component_id AS BIGINT) AS component_id, accepted, ROUND(CAST(acceptance_score AS DOUBLE), 6) AS acceptance_score, reject_reasons FROM verdicts
    UNION ALL SELECT -1, '', -1, 0, false, 0, '' FROM unfinished""")
def _(spark, d):
    out = verdicts(spark, d)
    return out.select("tile_id", "zone", root(), "component_id", "accepted", *r6("acceptance_score"), F.array_join("reject_reasons", ",").alias("reject_reasons"))


@query("PRO-07", f"""{VERDICT} SELECT variant, tile_id, y, x FROM (SELECT c.tile_id, c.y, c.x, unnest(list_filter(['candidate_mask', CASE WHEN c.zone = 'inside_buffer_auto' THEN 'candidate_inside_mask' ELSE 'candidate_outside_mask' END,
    CASE WHEN c.zone <> 'inside_buffer_auto' THEN 'evaluated_outside_mask' END, CASE WHEN accepted AND c.zone = 'inside_buffer_auto' THEN 'accepted_inside_mask' END,
    CASE WHEN accepted AND c.zone <> 'inside_buffer_auto' THEN 'accepted_outside_mask' END, CASE WHEN accepted THEN 'accepted_mask' ELSE 'rejected_mask' END], lambda v: v IS NOT NULL)) AS variant
    FROM pro_cells c JOIN verdicts v ON v.tile_id = c.tile_id AND v.zone = c.zone AND v.root = CAST(c.root AS BIGINT))""")
def _(spark, d):
    cells = cut(object_cells(spark, d), "objects")
    return proposals.proposal_masks(cells, proposals.evaluate(cells, RULES, 1.0), RULES).select("variant", "tile_id", "y", "x")


@query("PRO-08", """SELECT DISTINCT tile_id, y, x FROM (SELECT tile_id, y, x FROM ctx WHERE score >= 0.4 AND buffer AND r + g + b >= 200 UNION ALL
    SELECT tile_id, y, x FROM candidates WHERE zone = 'inside_buffer_auto')""")
def _(spark, d):
    """The bright mask with the automatically accepted objects."""
    ctx = context(spark, d)
    accepted = candidate_cells(spark, d).filter(F.col("zone") == proposals.INSIDE)
    return proposals.with_proposals(ctx.filter("score >= 0.4 and buffer and r + g + b >= 200"), accepted)

from __future__ import annotations

import math

import numpy as np
import pytest
from helpers import blobs, box_distance, dense_df, label_components, mask_df, thin
from pyspark.sql import functions as F

from gridloom.operators import proposals

CFG = proposals.ProposalConfig(min_area_px=4, min_length_m=2, max_width_m=3, min_skeleton_ratio=.5, min_pca_ratio=1.2,
                               max_circularity=2.0, min_mean_score=.3, max_road_overlap=.5)


def brute(g, zone, score, road, cfg, px=1.0):
    """Objects of both zones with metrics and verdicts, one at a time."""
    out = {}
    for name in (proposals.INSIDE, proposals.OUTSIDE):
        labels = label_components(g & zone if name == proposals.INSIDE else g & ~zone, 2)
        for k in range(1, labels.max() + 1):
            one = labels == k
            ys, xs = np.nonzero(one)
            area = len(ys)
            pca = 1.0
            if area > 1:
                e = np.sort(np.linalg.eigvalsh(np.cov(np.stack([ys, xs]))))[::-1]
                pca = max(e[0], 1e-8) / max(e[1], 1e-8)
            m = {"area_px": area, "pca_ratio": pca, "mean_score": score[one].mean(), "road_overlap": road[one].mean()}
            ok = {r: False for r in proposals.RULES}
            ok.update(min_area_px=area >= cfg.min_area_px, min_pca_ratio=pca >= cfg.min_pca_ratio,
                      min_mean_score=m["mean_score"] >= cfg.min_mean_score, max_road_overlap=m["road_overlap"] <= cfg.max_road_overlap)
            inside = name == proposals.INSIDE
            if inside or all(ok[c] for c in proposals.CHEAP):
                p = np.pad(one, 1)
                inner = p[1:-1, 1:-1] & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
                edge = area - inner.sum()
                skel, dist = thin(one), box_distance(one)
                length = skel.sum()
                width = 2 * np.mean([dist[tuple(c)] for c in np.argwhere(skel)]) if length else 0.0
                m.update(circularity=4 * math.pi * area / (edge ** 2 + 1e-8), length_px=length, mean_width_px=width, skeleton_ratio=length / max(width, 1e-6))
                allowed = min(cfg.hard_width_cap_m, cfg.max_width_m + cfg.width_bonus_per_pca * max(pca - cfg.min_pca_ratio, 0))
                if all(ok[c] for c in proposals.CHEAP):
                    ok.update(min_length_m=length * px >= cfg.min_length_m, max_width_m=width * px <= allowed,
                              min_skeleton_ratio=m["skeleton_ratio"] >= cfg.min_skeleton_ratio, max_circularity=m["circularity"] <= cfg.max_circularity)
            first = tuple(np.argwhere(one)[0])
            out[name, first] = {**m, "accepted": inside or all(ok.values()), "score": 1.0 if inside else sum(ok.values()) / 8,
                                "reasons": [] if inside else [r for r in proposals.RULES if not ok[r]]}
    return out


@pytest.fixture(scope="module")
def case(spark):
    g = blobs(21, 28, 26, 0.52)
    rng = np.random.default_rng(4)
    score, road, zone = rng.random(g.shape), rng.random(g.shape) < .3, np.zeros(g.shape, bool)
    zone[:, :9] = True
    none = mask_df(spark, np.zeros((1, 1), bool))
    cand = proposals.candidates(mask_df(spark, g), none, mask_df(spark, zone))
    cells = proposals.objects(cand).join(dense_df(spark, {"score": score, "road": road}), ["tile_id", "y", "x"]).cache()
    verdicts = proposals.evaluate(cells, CFG, 1.0).cache()
    return g, zone, score, road, cells, verdicts


def test_verdicts_match_brute_force(case):
    g, zone, score, road, _, verdicts = case
    want = brute(g, zone, score, road, CFG)
    rows = verdicts.collect()
    assert len(rows) == len(want) and {r["accepted"] for r in rows if r["zone"] == proposals.OUTSIDE} == {True, False}
    for r in rows:
        w = want[r["zone"], (r["root"] >> 31, r["root"] & ((1 << 31) - 1))]
        for name in ("area_px", "mean_score", "road_overlap"):
            assert r[name] == pytest.approx(w[name])
        assert min(r["pca_ratio"], 1e6) == pytest.approx(min(w["pca_ratio"], 1e6), rel=1e-6)
        for name in ("circularity", "length_px", "mean_width_px", "skeleton_ratio"):
            assert r[name] == (pytest.approx(w[name]) if name in w else None)
        assert (r["accepted"], r["acceptance_score"], r["reject_reasons"]) == (w["accepted"], w["score"], w["reasons"])


def test_ids_count_inside_objects_first(case):
    rows = sorted(case[5].collect(), key=lambda r: r["component_id"])
    assert [r["component_id"] for r in rows] == list(range(1, len(rows) + 1))
    assert [(r["zone"], r["root"]) for r in rows] == sorted((r["zone"], r["root"]) for r in rows)


def test_masks_partition_the_candidates(case):
    g, zone, *_, cells, verdicts = case
    n = {r["variant"]: r["count"] for r in proposals.proposal_masks(cells, verdicts, CFG).groupBy("variant").count().collect()}
    assert n["candidate_mask"] == g.sum() == n["accepted_mask"] + n["rejected_mask"]
    assert n["candidate_inside_mask"] == n["accepted_inside_mask"] == (g & zone).sum()
    assert n["evaluated_outside_mask"] == (g & ~zone).sum()


def test_disabled_proposals_accept_nothing(case):
    off = proposals.ProposalConfig(enabled=False)
    names = {r[0] for r in proposals.proposal_masks(case[4], case[5], off).select("variant").distinct().collect()}
    assert names == {"candidate_mask", "candidate_inside_mask", "candidate_outside_mask"}


def test_object_row_literal(spark):
    cfg = proposals.ProposalConfig(min_area_px=5)
    row = spark.createDataFrame([(0, proposals.OUTSIDE, 0, 6.0, 8.0, .9, 0.0, 18.0, 18.0, 12.0, 9.0, .2)],
                                "tile_id int, zone string, root bigint, area_px double, pca_ratio double, mean_score double, road_overlap double, length_px double, length_m double, mean_width_m double, skeleton_ratio double, circularity double")
    out = proposals.checks(row, cfg).first()
    assert out["allowed_width_m"] == 15 and out["max_width_m"]
    assert proposals.accept(proposals.checks(row, cfg)).first()["accepted"]
    failed = proposals.accept(proposals.checks(row.withColumn("area_px", F.lit(2.0)), cfg)).first()
    assert failed["acceptance_score"] == 3 / 8 and len(failed["reject_reasons"]) == 5


def test_a_measure_at_its_limit_meets_it_wherever_the_object_lies(spark):
    """The shape's elongation is exactly 1.2; var_samp and sqrt give 1.2 plus or minus a few last bits, by position and order."""
    shapes = [((0, 0), (0, 1), (0, 2), (1, 0), (1, 2), (2, 1)), ((0, 0), (0, 1), (1, 0), (1, 2), (2, 0), (2, 1)), ((0, 1), (0, 2), (1, 0), (1, 2), (2, 1), (2, 2))]
    rows = [(0, proposals.OUTSIDE, 1000 * k + i, dy * 7 + y, dx * 5 + x, 0.3, False) for k, s in enumerate(shapes) for i, (dy, dx) in enumerate((a, b) for a in range(6) for b in range(6)) for y, x in s]
    cells = spark.createDataFrame(rows, "tile_id int, zone string, root long, y int, x int, score double, road boolean")
    got = proposals.cheap_checks(proposals.basic_metrics(cells, proposals.object_key()), CFG).select("pca_ratio", "min_pca_ratio", "min_mean_score").collect()
    assert len(got) == 36 * len(shapes) and all(r["pca_ratio"] == pytest.approx(1.2, abs=1e-12) for r in got)
    assert any(r["pca_ratio"] < 1.2 for r in got) and all(r["min_pca_ratio"] and r["min_mean_score"] for r in got)

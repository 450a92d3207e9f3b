"""Score, probability and rule expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8
CLIP = 1e-6
# fixed values: trimap confidences (inside, uncertain ring, outside)
TRIMAP_FG, TRIMAP_RING, TRIMAP_BG = 0.98, 0.5, 0.02


def clip01(p: Column, eps: float = CLIP) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p))


def entropy(p: Column) -> Column:
    q = clip01(p)
    return -q * F.ln(q) - (1.0 - q) * F.ln(1.0 - q)


def logistic(score: Column, center: float, softness: float, in_buffer: Column | None = None) -> Column:
    p = clip01(1.0 / (1.0 + F.exp(-(score - F.lit(center)) / F.lit(softness))))
    return p if in_buffer is None else F.when(in_buffer, p).otherwise(F.lit(CLIP))


def trimap(in_mask: Column, in_dilated: Column, in_buffer: Column | None = None) -> Column:
    p = F.when(in_mask, TRIMAP_FG).when(in_dilated, TRIMAP_RING).otherwise(TRIMAP_BG)
    return p if in_buffer is None else F.when(in_buffer, p).otherwise(F.lit(CLIP))


def penalise(score: Column, on_road: Column | None, penalty: float) -> Column:
    if on_road is None or penalty >= 1.0:
        return score
    return F.when(on_road, score * F.lit(float(penalty))).otherwise(score)


def prior(score: Column, inside: Column, a: float, b: float, top: float | None) -> Column:
    scaled = F.when(inside, score * F.lit(float(a))).otherwise(score * F.lit(float(b)))
    floor = F.greatest(scaled, F.lit(0.0))
    return floor if top is None else F.least(floor, F.lit(float(top)))


def weighted_rgb(weights, r: Column, g: Column, b: Column) -> Column:
    wr, wg, wb = (F.lit(float(w)) if isinstance(w, (int, float)) else w for w in weights)
    return r.cast("double") * wr + g.cast("double") * wg + b.cast("double") * wb


def bright_enough(weights, threshold, r, g, b, score: Column | None = None, protect=None) -> Column:
    keep = weighted_rgb(weights, r, g, b) >= (F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold)
    if protect is None or score is None:
        return keep
    return keep | (score >= (F.lit(float(protect)) if isinstance(protect, (int, float)) else protect))


def allowed_width(pca: Column, base: float, min_pca: float, bonus: float, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.lit(float(base)) + F.lit(float(bonus)) * F.greatest(pca - F.lit(float(min_pca)), F.lit(0.0)))


def image_id(path: Column) -> Column:
    """Base name without its extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def run_number(path: Column) -> Column:
    """Number of a `run_<n>` folder, null for other names."""
    digits = F.regexp_extract(path, r"run_([0-9]+)$", 1)
    return F.when(digits != "", digits.cast("bigint"))


def reflect(i: Column, n: Column) -> Column:
    """Index mirrored with the edge repeated: -1 -> 0, n -> n-1."""
    m = F.pmod(i, 2 * n)
    return F.when(m >= n, 2 * n - 1 - m).otherwise(m)


def mirror(i: Column, n: Column) -> Column:
    """Index mirrored about the first and last sample: -1 -> 1, n -> n-2."""
    m = F.pmod(i, F.greatest(2 * n - 2, F.lit(1)))
    return F.when(m >= n, 2 * n - 2 - m).otherwise(m)


def mercator_x(lon: Column) -> Column:
    return lon * F.lit(MERCATOR_RADIUS * math.pi / 180.0)


def mercator_y(lat: Column) -> Column:
    return F.ln(F.tan(F.lit(math.pi / 4.0) + lat * F.lit(math.pi / 360.0))) * F.lit(MERCATOR_RADIUS)


def inverse_mercator_lon(x: Column) -> Column:
    return x / F.lit(MERCATOR_RADIUS * math.pi / 180.0)


def inverse_mercator_lat(y: Column) -> Column:
    return (F.atan(F.exp(y / F.lit(MERCATOR_RADIUS))) - F.lit(math.pi / 4.0)) * F.lit(360.0 / math.pi)


# fixed value: sphere radius of the web Mercator projection, metres
MERCATOR_RADIUS = 6378137.0

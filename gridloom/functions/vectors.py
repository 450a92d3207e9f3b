"""Array-of-number expressions, all on the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def to_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(to_double(a), to_double(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(to_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2(v: Column) -> Column:
    """v / (|v| + 1e-8)"""
    return F.element_at(
        F.transform(F.array(norm(v) + EPS), lambda n: F.transform(to_double(v), lambda x: x / n)), 1)


def scale(v: Column, w: float) -> Column:
    return F.transform(to_double(v), lambda x: x * F.lit(float(w)))


def zscore(v: Column, mean: Column, std: Column) -> Column:
    centred = F.zip_with(to_double(v), mean, lambda x, m: x - m)
    return F.zip_with(centred, std, lambda x, s: x / s)


def weighted_sum(pairs: Column) -> Column:
    """Element-wise sum of w * v over an array of struct(w, v); every v has the same length."""
    zero = F.transform(F.element_at(pairs, 1)["v"], lambda x: F.lit(0.0))
    return F.aggregate(pairs, zero, lambda acc, p: F.zip_with(acc, p["v"], lambda a, x: a + x * p["w"]))


def concat_all(blocks: list[Column]) -> Column:
    return reduce(lambda a, b: F.concat(a, b), blocks)

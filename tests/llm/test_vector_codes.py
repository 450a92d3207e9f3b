"""Product codes against plain Python integers."""

from __future__ import annotations

import collections
import hashlib
import math

import numpy as np
import pytest

from gridloom.llm import vector_codes
from gridloom.llm.vector_codes import Codes


@pytest.mark.parametrize("bits", [None, 1, 3, 11, 24])
def test_limb_products_are_exact(bits):
    rng = np.random.default_rng(1)
    for size in (5, 1 << 11, 1 << 25):
        x, c = (rng.integers(-size, size + 1, (n, 16)) for n in (40, 30))
        want = [[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in c] for r in x]
        assert vector_codes.products(x, c, bits).tolist() == want
    assert 16 * ((1 << vector_codes.limb_bits(16)) - 1) ** 2 < 1 << 53


@pytest.mark.parametrize("size", [3, 1 << 26, 1 << 40, 10**30])
def test_nearest_takes_the_first_least(size):
    rng = np.random.default_rng(2)
    x = np.array([[int(v) * size for v in r] for r in rng.integers(-3, 4, (50, 4))], object)
    c = np.array([[int(v) * size for v in r] for r in rng.integers(-2, 3, (20, 4))], object)
    at, d = vector_codes.nearest(x, c, None if size > 1 << 30 else 20)
    for i, r in enumerate(x):
        every = [sum((a - b) ** 2 for a, b in zip(r, s, strict=True)) for s in c]
        assert (int(d[i]), int(at[i])) == (min(every), every.index(min(every)))


def _plain(rows, codes):
    """Codes, errors and digest by loops over Python integers."""
    kept = sorted(((i, lab, [math.floor(codes.scale * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = max(1, -(-max((len(v) for *_, v in kept), default=0) // codes.parts))
    kept = [(i, lab, v + [0] * (width * codes.parts - len(v))) for i, lab, v in kept]
    split = [[v[p * width:(p + 1) * width] for p in range(codes.parts)] for *_, v in kept]
    books = [[s[p] for s in split[:codes.entries]] for p in range(codes.parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda a, book: min((dist(a, e), k) for k, e in enumerate(book))
    for _ in range(codes.rounds):
        for p, book in enumerate(books):
            held = collections.defaultdict(list)
            for s in split:
                held[near(s[p], book)[1]].append(s[p])
            books[p] = [[sum(c) // len(held[k]) for c in zip(*held[k], strict=True)] if k in held else e for k, e in enumerate(book)]
    found = [[near(s[p], books[p]) for p in range(codes.parts)] for s in split]
    errors = [sum(d for d, _ in f) for f in found]
    totals = collections.Counter()
    for (_, lab, _), e in zip(kept, errors, strict=True):
        totals[lab] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((repr(i), "".join(f"{k:02x}" for _, k in f), e, totals[lab], digest) for (i, lab, _), f, e in zip(kept, found, errors, strict=True))


@pytest.mark.parametrize("codes", [Codes(entries=5), Codes(entries=5, label_bytes=0, salts=3), Codes(entries=7, limb_bits=4), Codes()])
def test_codes_equal_the_definition(spark, codes):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], i % 3 if i % 4 else None) for i in range(60)]
    rows += [(i, rows[2][1], 1) for i in range(100, 140)]  # copies
    rows += [(7, [float(x) for x in rng.normal(size=8)], 2), (None, [0.5] * 8, 1), (200, None, 0), (201, [float("nan")] * 8, 0), (202, [float("inf")] + [0.0] * 7, 0), (203, [None] * 8, 0), (204, [1.0, 2.0, 3.0], 0), (205, [], 0)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, code string, error string").repartition(6)
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    got = sorted((repr(r[0]), *tuple(r)[1:]) for r in vector_codes.compressed(df, codes).collect())
    assert got == _plain(as_float, codes)


def test_large_and_missing_vectors(spark):
    rows = [(i, [s * 1e17, -s * 3.0, s * 1e9, 4.0], i % 2) for i, s in enumerate([1.0, -1.0, 2.0, 0.5, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    codes = Codes(entries=2, parts=2)
    want = [(i, c, e if e < 1 << 63 else None, d) for i, c, e, _, d in _plain(rows, codes)]
    assert sorted((repr(r[0]), r[1], r[2], r[4]) for r in vector_codes.compressed(df, codes).collect()) == want
    for none in ([], [(1, None, 3)]):
        assert vector_codes.compressed(spark.createDataFrame(none, df.schema)).collect() == []

"""Summaries at every n-th tile do not depend on where batches begin."""

from __future__ import annotations

import random

import pytest

from gridloom.plans.scratch import new_path
from gridloom.streaming import live

SCHEMA = "phase string, stage string, substage string, duration_s double, position long, final boolean"


@pytest.mark.parametrize("cuts", [(40,), (3, 4, 20), (1, 2, 3, 39)])
def test_counted_summaries(spark, cuts):
    rng = random.Random(3)
    rows = [(None, rng.choice("ab"), None, float(i), i, rng.random() < 0.3) for i in range(40)]
    source, out, ck = (new_path(spark, n) for n in ("in", "out", "ck"))
    low = 0
    for high in (*cuts, 40):
        if high > low:
            spark.createDataFrame(rows[low:high], SCHEMA).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(SCHEMA).parquet(source)
            live.stream_tile_summaries(stream, 3, out, ck).awaitTermination()  # stopped and started again for each part
            low = high
    want, done = set(), 0
    for i, r in enumerate(rows):
        done += r[5]
        if r[5] and done % 3 == 0:
            for stage in "ab":
                seen = [x[3] for x in rows[:i + 1] if x[1] == stage]
                if seen:
                    want.add((done, None, stage, None, len(seen), sum(seen), min(seen), max(seen)))
    assert {tuple(r) for r in live.tile_summaries(spark, out).collect()} == want and want


def test_no_summary_yet(spark):
    assert live.tile_summaries(spark, new_path(spark, "nothing")).collect() == []

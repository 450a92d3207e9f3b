"""Registered queries against their SQL at the smallest scale; GRIDLOOM_ALL=1 runs every one."""

from __future__ import annotations

import os

import duckdb
import pytest
from check_oracles import TABLES, TYPES, norm

import __spark_entry__ as entry

SAMPLE = ["SRC-01", "SRC-03", "SRC-08", "SNK-01", "SNK-10", "CAT-01", "CAT-07", "CAT-13", "TIL-01", "TIL-05", "NBR-02", "NBR-04", "NBR-06", "NBR-13", "SCL-01",
          "FEA-06", "FEA-07", "MOD-01", "MOD-05", "MOD-13", "SPA-01", "SPA-04", "MET-02", "MET-08", "MET-11", "MET-15", "PRO-02", "LOG-04", "LOG-06", "STR-01", "UDF-01"]
NAMES = list(entry.queries()) if os.environ.get("GRIDLOOM_ALL") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    names = sorted(df.columns)
    got = sorted(tuple(norm(r[n]) for n in names) for r in df.collect())
    if name not in entry.oracle_sql():
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    cols = [(c[0], str(c[1])) for c in cur.description]
    types = {c: TYPES.get(t, t) for c, t in df.dtypes}
    assert sorted(cols) == sorted(types.items())
    pos = {c: i for i, (c, _) in enumerate(cols)}
    assert got == sorted(tuple(norm(r[pos[n]]) for n in names) for r in cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_is_lazy_and_stable(spark):
    df = entry.entry(spark)
    assert df.columns == ["thr_idx", "threshold", "iou"] and df.count() == 1

"""The pipeline's stages against their decisions in plain Python."""

from __future__ import annotations

import collections
import re

import corpus_pipeline
import numpy as np
import pytest
from fixtures import components as _components
from fixtures import shingles as _shingles

import __spark_entry__ as entry
from gridloom.llm import token_ids, toxicity


def test_stages_end_to_end(spark, sf):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name == "packing":
            break
        assert out.columns == columns and out.schema == docs.schema
        rows = {r["doc_id"]: r["text"] for r in out.collect()}
        if name != "secrets":
            assert set(rows) <= set(seen) and all(seen[i] == t for i, t in rows.items())
        if name == "near_duplicates":
            sets = {i: _shingles(t) for i, t in seen.items()}
            ids = [i for i in sets if sets[i]]
            roots = _components(sets, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
            assert set(rows) == {i for i, r in roots.items() if i == r}
        if name == "secrets":
            assert set(rows) == set(seen) and not any(re.search(r"[0-9a-f]{16,}|AKIA[A-Z0-9]{14,}", t or "") for t in rows.values())
            assert all(rows[i] == t or "[SECRET]" in rows[i] for i, t in seen.items())
        assert len(rows) > 0.5 * len(seen)
        docs, seen = spark.createDataFrame(out.collect(), docs.schema), rows
    library, got = token_ids.load(token_ids.path(token_ids.WORD_BPE)), collections.defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append((r["start"], r["ids"]))
    assert {i: [x for _, p in sorted(v) for x in p] for i, v in got.items()} == {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in seen.items()}


def test_repeated_ids_leave_one_row(spark, sf):
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "A b c d e f", "en", "s", 1), (None, None, None, None, None), (3, "x y", "en", "s", 1)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf}/documents.parquet").schema)
    out = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 3]


def test_every_operator_is_registered():
    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op") and n != "op4_noisy_or_toxicity"])
def test_queries_cover_their_table(spark, sf, name):
    out = entry.queries()[name](spark, sf)
    number = int(name[2:].split("_")[0])
    table, key = ("embeddings", "vec_id") if number in (8, 13) else ("conversations", "conv_id") if number in (11, 12) else ("documents", "doc_id")
    extra = {-7} if number == 11 else set()  # one more conversation is formatted
    assert {r[0] for r in out.select(key).distinct().collect()} == {r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key).collect()} | extra


def test_toxic_stage_and_query_share_one_limit(spark, sf, monkeypatch):
    fit = toxicity.Fit()
    model = toxicity.Model(np.zeros(1 << fit.bits, np.float32), float(np.log(0.4 / 0.6)), fit)  # every sentence scores 0.4
    monkeypatch.setattr(toxicity, "train", lambda *_, **__: model)
    docs = spark.createDataFrame([(1, "one sentence", "en", "s", 12), (2, "", "en", "s", 0)], spark.read.parquet(f"{sf}/documents.parquet").schema)
    assert [r["doc_id"] for r in corpus_pipeline.toxic(spark, docs, sf).collect()] == [2]
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in entry.queries()["op4_noisy_or_toxicity"](spark, sf).collect())


def test_few_removed_ids_go_to_the_texts(spark, sf):
    """Before, the planner took the size of all groups for that of the removed ids, so from some size on every text went through a shuffle."""
    docs = spark.range(30_000).selectExpr("id AS doc_id", "concat('w', id % 29990, ' b c d e f') AS text", "'en' AS lang", "'s' AS source", "1 AS n_chars").select(spark.read.parquet(f"{sf}/documents.parquet").columns)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        out = corpus_pipeline.near_duplicates(spark, docs, sf)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {r[0] for r in out.select("doc_id").collect()} == set(range(29_990))

"""Models and joins against plain Python, held-out accuracy, and defined cases."""

from __future__ import annotations

import collections
import dataclasses
import math
import random
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from fixtures import SCHEMA, corpus, frame
from fixtures import components as _components
from fixtures import shingles as _shingles
from pyspark.sql import functions as F

from gridloom.llm import importance, katz, lexicon, metric_join, ngram_join, packing, plane_files, quality_rules, secret_scan, token_ids, toxicity
from gridloom.llm.common import fold
from gridloom.llm.links import local_roots


def _discount(counts, k=5, tail=0.5):
    n, out = collections.Counter(counts.values()), {}
    for r in range(1, k + 1):
        try:
            cut = (k + 1) * n[k + 1] / n[1]
            d = ((r + 1) * n[r + 1] / n[r] / r - cut) / (1 - cut)
        except ZeroDivisionError:
            d = -1
        out[r] = d if 0 < d < 1 else (r - tail) / r
    return lambda c: c * out[c] if c <= k else c - tail


def test_katz_equals_the_definition_and_sums_to_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(10**7, None), (10**7 + 1, ""), (10**7 + 2, "the zzqx the of"), (10**7 + 3, "The of the of the")], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in katz.score(docs, fold("doc_id", 5) == 1, katz.Settings(slice_bytes=50_000)).collect()}
    texts = {r[0]: [*(r[1] or "").encode().lower().split(), b""] for r in docs.collect()}
    one, two, starts_ = collections.Counter(), collections.Counter(), 0
    for i, w in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            starts_ += 1
            one.update(w)
            two.update(zip([None, *w[:-1]], w, strict=True))
    n, types = sum(one.values()), len(one)
    d1, d2 = _discount(one), _discount(two)
    unknown = 1 - sum(map(d1, one.values())) / n
    p1 = lambda w: d1(one[w]) / n if w in one else unknown
    before = {**one, None: starts_}
    after = collections.defaultdict(list)
    for (h, w), c in two.items():
        after[h].append((w, c))
    alpha = {h: (1 - sum(d2(c) / before[h] for _, c in x)) / (1 - sum(p1(w) for w, _ in x)) for h, x in after.items()}
    p = lambda w, h: d2(two[h, w]) / before[h] if (h, w) in two else alpha.get(h, 1.0) * p1(w)
    for h in [None, b"the", *random.Random(1).sample(list(one), 3)]:
        assert sum(p(w, h) for w in one) + alpha.get(h, 1.0) * unknown == pytest.approx(1, abs=1e-9)
    for i, w in texts.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(x in one for x in w), n, zlib.crc32(str(i).encode()) % 5 == 1)
        assert r["score"] == pytest.approx(sum(math.log10(p(x, h)) for h, x in zip([None, *w[:-1]], w, strict=True)), rel=1e-9)
        assert r["base_score"] == pytest.approx(sum(math.log10((one[x] + 0.5) / (n + 0.5 * (types + 1))) for x in w), rel=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_katz_takes_nothing_from_counts_above_five(spark, sf):
    """Before, counts above five lost 0.5, so that contexts whose pairs are all frequent had mass to back off with."""
    odd = [(10**7 + i, "zzqx yyqx " * 8) for i in range(10)] + [(10**7 + 20, "zzqx zzqx the"), (10**7 + 21, "zzqx yyqx of")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    held = F.col("doc_id").isin(10**7 + 20, 10**7 + 21)
    got = {r["doc_id"]: r["score"] for r in katz.score(docs, held, dataclasses.replace(katz.KATZ, slice_bytes=50_000)).collect()}
    texts = {r[0]: [*(r[1] or "").encode().lower().split(), b""] for r in docs.collect()}
    one, two = collections.Counter(), collections.Counter()
    for i, w in texts.items():
        if i < 10**7 + 20:
            one.update(w)
            two.update(zip([None, *w[:-1]], w, strict=True))
    n = sum(one.values())
    d1, d2 = ((lambda c, d=_discount(x): d(c) if c <= 5 else c) for x in (one, two))
    before = {**one, None: len(texts) - 2}
    after = collections.defaultdict(list)
    for (h, w), c in two.items():
        after[h].append((w, c))
    unknown = sum(c - d1(c) for c in one.values()) / n
    p1 = lambda w: d1(one[w]) / n if w in one else unknown
    total, alpha = {}, {}
    for h, x in after.items():
        freed = sum(c - d2(c) for _, c in x)
        total[h], freed = (before[h], freed) if freed else (before[h] + 1, 1)
        alpha[h] = freed / total[h] / (1 - sum(p1(w) for w, _ in x))
    assert total[b"zzqx"] == one[b"zzqx"] + 1 and total[b"the"] == one[b"the"]
    p = lambda w, h: d2(two[h, w]) / total[h] if (h, w) in two else alpha.get(h, 1.0) * p1(w)
    for h in [None, b"the", b"zzqx", b"yyqx"]:
        assert sum(p(w, h) for w in one) + alpha[h] * unknown == pytest.approx(1, abs=1e-9)
    for i, w in texts.items():
        assert got[i] == pytest.approx(sum(math.log10(p(x, h)) for h, x in zip([None, *w[:-1]], w, strict=True)), rel=1e-9)


def test_katz_counts_beyond_32_bits(spark):
    """Before, counts were cut at 2^32 - 1, and pair counts from 2^31 on made every chunk the owner, so that contexts summed them once for each."""
    docs = frame(spark, [(1, "ab cd ab cd"), (2, "cd ab")]).select("doc_id", "text").withColumn("held", F.lit(False)).coalesce(1)
    many, dealt = 3 * 10**9, katz._deal(docs, 1, katz.KATZ).toPandas()
    for c in ("b", "d"):  # as if this chunk had each word and pair so often, and another chunk too
        dealt[c] = [katz._pack(np.full(len(katz._unpack(x, "<u4")), many, "<u4")) if part >= 0 else x for part, x in zip(dealt["part"], dealt[c], strict=True)]
    own, keys = dealt[dealt["part"] < 0], dealt[dealt["part"] >= 0]
    counted = katz._count(5)(pd.concat([keys, keys.assign(chunk=keys["chunk"] + 1)], ignore_index=True))
    words, pairs = 3, 6
    totals = katz.Totals(2 * many * words, words, 2 * many, katz.Discount((0,) * 6, 0.0), katz.Discount((0,) * 6, 0.0), 0.0)
    seen = []
    for chunk, rest in counted[counted["chunk"] >= 0].groupby("chunk"):
        asked = katz._back_off(totals, 1)(pd.concat([own.assign(chunk=chunk), rest], ignore_index=True))
        at = asked[asked["part"] >= 0].iloc[0]
        assert set(katz._unpack(at["d"], "<u8").tolist()) == {2 * many}
        seen.append(katz._unpack(at["c"], "<f8").sum())
    # start ab, start cd, ab cd, cd ab, and the ends: each pair's word once, by one chunk
    p = 2 * many / (2 * many * words + 1)
    assert sorted(seen) == pytest.approx([0, pairs * p])


@pytest.mark.parametrize("s", [ngram_join.Settings(), ngram_join.Settings(crowd=3, block=4, hot=2, parts=7), ngram_join.Settings(percent=60, crowd=2, block=5)])
def test_ngram_join_equals_all_pairs(spark, s):
    rows = corpus(n=40)
    got = {r[0]: (r[1], r[2]) for r in ngram_join.near_duplicates(frame(spark, rows), s).collect()}
    sets = {i: _shingles(t) for i, t in rows}
    ids = [i for i in sets if sets[i]]
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if 100 * len(sets[a] & sets[b]) >= s.percent * len(sets[a] | sets[b])]
    want = _components(sets, links)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert 1 < collections.Counter(want.values()).most_common(1)[0][1] < 36


def test_ngram_join_on_the_shared_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r[0]: (r[1], r[2]) for r in ngram_join.near_duplicates(docs).collect()}
    sets = {r["doc_id"]: _shingles(r["text"]) for r in docs.collect()}
    ids = [i for i in sets if sets[i]]
    want = _components(sets, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def _vectors(seed=3, n=150, d=16):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    v[100:130] = v[7] + rng.normal(scale=0.25, size=(30, d))
    v[130:] = v[9]
    return [(i, [float(x) for x in r]) for i, r in enumerate(v)]


def test_ngram_join_of_more_rows_than_a_slice_numbers(spark):
    """Many short texts in one Arrow batch: rows of a slice are numbered in 16 bits."""
    pairs = 33_000
    docs = spark.range(2 * pairs).selectExpr("id AS doc_id", f"concat('word', id % {pairs}, ' b c d e f') AS text").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "0")
    try:
        wrong = ngram_join.near_duplicates(docs).filter(f"component_id <> doc_id % {pairs} or n_shingles <> 2").count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert wrong == 0


@pytest.mark.parametrize("s", [metric_join.Settings(), metric_join.Settings(block=7, pivots_per_root=1.0), metric_join.Settings(block=500, pivots_per_root=3.0)])
def test_metric_join_equals_all_pairs(spark, s):
    good = _vectors()
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, 2.0]), (904, [1.0, 2.1]), (905, []), (906, [None, 1.0]), (907, [float("inf")] * 16)]
    got = {r[0]: tuple(r)[1:] for r in metric_join.near_duplicates(spark.createDataFrame(good + odd, "vec_id long, embedding array<double>"), s).collect()}
    m = np.array([v for _, v in good])
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.9
    want = _components(range(len(good)), zip(*np.nonzero(near), strict=True))
    for i, _ in good:
        assert got[i] == (int(near[i].sum()) - 1, want[i], want[i] == i)
    assert got[903] == (1, 903, True) and got[904] == (1, 903, False)
    assert all(got[i] == (0, i, True) for i in (900, 901, 902, 905, 906, 907))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_metric_join_in_rounds_sends_no_copies(spark, kind):
    """Before, each vector crossed the network once for every block it is compared with."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(800, 24))
    v[500:560] = v[7] + rng.normal(scale=0.1, size=(60, 24))
    v[560:600] = v[560:600] * 0.2 + v[9]
    v[600:610] = v[11]
    v = v.astype(np.float32).astype(float)
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], f"vec_id long, embedding array<{kind}>")
    status = spark.sparkContext._jsc.sc().statusStore()

    def sent():
        time.sleep(0.5)
        return sum(status.executorList(False).apply(k).totalShuffleWrite() for k in range(status.executorList(False).size()))

    before = sent()
    s = metric_join.Settings(block=16, pivots_per_root=0.3, round_bytes=24 * 1024)  # some cells fill a round together, some are cut
    got = {r[0]: tuple(r)[1:] for r in metric_join.near_duplicates(rows, s).collect()}
    assert sent() - before < 5 * v.nbytes
    m = v / np.linalg.norm(v, axis=1)[:, None]
    near = m @ m.T >= 0.9
    want = _components(range(len(v)), zip(*np.nonzero(near), strict=True))
    assert got == {i: (int(near[i].sum()) - 1, want[i], want[i] == i) for i in range(len(v))} and near.sum() > 4000


def test_local_roots():
    assert list(local_roots(6, np.array([5, 3]), np.array([3, 1]))) == [0, 1, 2, 1, 4, 1]


def test_importance_drops_junk_and_keeps_the_clean(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    weighed, _, least = importance.select(docs, labels)
    out = {(r["quality"], r["kept"]): r["n"] for r in weighed.withColumn("kept", F.col("gumbel_key") >= least).join(labels, "doc_id").groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert out.get((1, False), 0) <= 0.02 * out[1, True] and out.get((0, True), 0) <= 0.25 * out[0, False]


def test_importance_draws_exactly_k(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    weighed, _, least = importance.select(docs, labels, k=37)
    keys = sorted((r[0] for r in weighed.select("gumbel_key").collect()), reverse=True)
    assert least == keys[36]


@pytest.mark.parametrize("at_once", [500_000, 9_000])
def test_importance_reads_all_labelled_documents(spark, at_once):
    """Before, the target and the cut were taken from at most 20,000 labelled documents."""
    n = 24_000
    rows = [(i, f"w{i % 977} w{i % 31} end" if i % 5 else None) for i in range(n)]
    docs = frame(spark, [*rows, (None, "w1 w2"), *[(n + i, "raw only") for i in range(50)]])
    labels = spark.createDataFrame([(i, 1) for i, _ in rows] + [(3, 1), (None, 1), (n, 0), (10**9, 1)], "doc_id long, quality int")
    s = importance.Settings(bits=10, ids_at_once=at_once)
    memo = importance.word_hashes()
    raw, target = (np.bincount(importance._buckets([(t or "").encode() for _, t in x], memo, s.bits)[0], minlength=1 << s.bits) for x in ([*rows, (None, "w1 w2"), *[(0, "raw only")] * 50], rows))
    want = [np.log((c + s.smoothing) / (c.sum() + s.smoothing * len(c))) for c in (target, raw)]
    got = importance.log_ratios(docs, labels, s)
    assert np.allclose(got, want[0] - want[1], atol=1e-12)


@pytest.mark.parametrize("case", ["mixed", "ties", "apart", "turned", "good only"])
def test_importance_cuts_where_fewest_of_all_labels_are_wrong(spark, case):
    rng = np.random.default_rng(2)
    n = 23_000 if case == "mixed" else 300
    y = np.ones(n, int) if case == "good only" else rng.integers(0, 2, n)
    x = rng.normal(size=n) + {"apart": 50, "turned": -50}.get(case, 1) * y
    if case == "ties":
        x = x.round(1)
    weighed = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(n, 0.0), (None, 9.0)], "doc_id long, gumbel_key double")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(10**9, 0), (None, 1), (n, None)], "doc_id long, quality int")
    keys = np.unique(x)
    wrong = [int((y == 0).sum())] + [int(((x <= v) & (y == 1)).sum() + ((x > v) & (y == 0)).sum()) for v in (keys if n < 1000 else [])]
    got = importance.best_cut(weighed, labels)
    if case == "mixed":
        order = np.argsort(x)
        wrong = np.concatenate([[0], np.cumsum(y[order])]) + (y == 0).sum() - np.concatenate([[0], np.cumsum(1 - y[order])])
    i = int(np.argmin(wrong))
    assert got == (-math.inf if i == 0 or y.all() else math.inf if i == len(keys) else (keys[i - 1] + keys[i]) / 2)


@pytest.mark.parametrize("k", [0, 1, 5, 6, 7, 50])
def test_kth_largest_with_ties(spark, k):
    values = [1.0, 1.0, 1.0, 2.0, 2.0, -7.5, 1e9]
    got = importance.kth_largest(spark.createDataFrame([(v,) for v in values], "x double"), "x", k, bins=4)
    assert got == (math.inf if k < 1 else -math.inf if k >= len(values) else sorted(values, reverse=True)[k - 1])


def test_toxicity_learns_sentences_from_documents(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(240):
        bag = [" ".join(rng.choice("ab cd ef gh ij kl mn op".split()) for _ in range(6)) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            bag[rng.randrange(len(bag))] += " vilename"
        rows.append((i, ". ".join(bag)))
        labels.append((i, int(i % 4 == 0)))
    docs, y = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, y.filter("doc_id % 3 <> 0"))
    out = toxicity.score(docs, model).collect()
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 4 == 0) for r in out)
    for r in out:
        if r["doc_id"] % 4 == 0:
            worst = r["offending"][0]["sentence"]
            assert b"vilename" in toxicity.sentences(r["text"].encode())[worst]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = fold("doc_id", 4) == 2
    model = toxicity.train(docs, labels.filter(~held), toxicity.Fit(sample=1500))
    r = toxicity.score(docs.join(labels.filter(held), "doc_id").select("doc_id", "text", "toxic"), model).withColumn("p", F.col("score") >= 0.3).groupBy("toxic", "p").count().collect()
    n = {(x["toxic"], x["p"]): x["count"] for x in r}
    assert n[1, True] / (n[1, True] + n[1, False]) > 0.5 and n[0, True] < 0.05 * n[0, False]


def test_toxicity_learns_rare_words_beside_common_ones(spark):
    """Toxic words of a small language, in few documents of a large sample, and labels without a document."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(6000):
        small, bad = i % 240 < 2, i % 8 == 0
        words = [rng.choice(("ka le mi no" if small else "ab cd ef gh ij kl mn op").split()) for _ in range(12)]
        rows.append((i, " ".join(words + [("zorgwit" if small else "vilename") if bad else "fine"]), "xx" if small else "en", "s", 1))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, SCHEMA)
    y = spark.createDataFrame(labels + [(10**6 + i, 0) for i in range(20000)], "doc_id long, toxic int")
    # 25 of the 750 toxic documents are of the small language; those of 8 of them are left out
    model = toxicity.train(docs, y.filter("doc_id % 720 < 480"), toxicity.Fit(sample=6000))
    out = toxicity.score(docs, model).collect()
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 8 == 0) for r in out)


def test_toxicity_sample_shares():
    sizes = {(0, 0): 90_000, (0, 1): 500, (1, 0): 9_000, (1, 1): 100}
    out, fit = toxicity.shares(sizes, toxicity.Fit()), toxicity.Fit()
    drawn = {k: out[k] * n for k, n in sizes.items()}
    assert out[1, 1] == 1.0 and 0.9 * fit.sample < sum(drawn.values()) <= fit.sample and drawn[1, 0] + drawn[1, 1] <= fit.toxic * fit.sample
    assert toxicity.shares({(0, 0): 10, (1, 3): 10}, fit) == {(0, 0): 1.0, (1, 3): 1.0}


def _operators(docs, labels):
    byte, word = token_ids.path(token_ids.BYTE_BPE), token_ids.path(token_ids.WORD_BPE)
    spark = docs.sparkSession
    yield katz.score(docs, fold("doc_id", 5) == 1)
    yield packing.packed(docs, word, 1)
    weighed, ratios, least = importance.select(docs, labels)
    yield importance.weigh(docs, ratios)
    yield toxicity.score(docs, toxicity.train(docs, labels))
    yield ngram_join.near_duplicates(docs)
    model = secret_scan.train(docs)
    yield secret_scan.report(docs, model)
    yield secret_scan.redact(docs, model)
    yield lexicon.encoded(docs, byte, lexicon.build(docs, byte))
    yield quality_rules.judge(docs, quality_rules.references(docs))
    from gridloom.plans.scratch import new_path
    folder = new_path(spark, "planes")
    plane_files.write(docs, folder, byte, 0)
    yield plane_files.read(spark, folder)


def test_parts_of_many_words_take_bounded_room():
    """The driver hashes the words of its sample a bounded number at a time: same parts in the same order, a tenth of the room."""
    import tracemalloc

    words, fit = [f"word{i * 7919}x{i}".encode() for i in range(120_000)], toxicity.Fit()
    part, owner = toxicity._parts(words, fit)
    order = np.argsort(owner, kind="stable")
    want, size = part[order], part.nbytes
    del part, order
    tracemalloc.start()
    got, of = toxicity._all_parts(words, fit)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all() and (of == np.sort(owner)).all() and peak < 8 * size
    assert all(len(x) == 0 for x in toxicity._all_parts([], fit))


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in _operators(spark.createDataFrame([], SCHEMA), labels):
        assert out.collect() == []
    assert metric_join.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(None, None), (None, "some words of a text here"), (1, None), (2, ""), (3, "same text of six words here"), (4, "same text of six words here"), (4, "same text of six words here"),
            (5, "password = abcdefghijklmnop " * 30000)]
    labels = spark.createDataFrame([(3, 1, 0), (2, None, None), (None, 0, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows, extra=True)
    for out in _operators(docs, labels):
        got = out.select("doc_id").collect() if "doc_id" in out.columns else []
        assert {r[0] for r in got} == {None, 1, 2, 3, 4, 5}
    near = {(r[0], r[1]): r[2] for r in ngram_join.near_duplicates(docs).collect()}
    assert near[4, 2] == 3 and near[1, 0] == 1 and near[None, 2] is None

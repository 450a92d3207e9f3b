"""Small document tables for the operators' tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "the of and river stone light under garden winter paper".split() for b in ("", "s", "ing", "er")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (". " if rng.random() < 0.1 else "") for _ in range(n)).replace("  ", " ")


def corpus(seed: int = 1, n: int = 60, words: int = 40) -> list[tuple[int, str | None]]:
    """Prose, a family of near copies, exact copies, short, empty and null texts."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(1, words))) for i in range(n)]
    base = prose(rng, 60).split()
    for i in range(30):  # one or more changed words each, some far from the rest
        copy = list(base)
        for _ in range(i % 6):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS) + str(i)
        rows.append((1000 + i, " ".join(copy)))
    rows += [(2000 + i, rows[3][1]) for i in range(5)]
    rows += [(3000, None), (3001, ""), (3002, " \n\t "), (3003, "one two"), (3004, "One  TWO"), (3005, "é\x1cb ñandú 日本 😀"), (3006, "a b c d e f " * 700)]
    return rows


def frame(spark, rows, extra: bool = False):
    df = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, None, None) for i, t in rows], SCHEMA)
    if extra:  # columns whose names operators use themselves
        from pyspark.sql import functions as F

        for name in ("score", "kept", "n", "component_id", "n_words", "ids", "log_ratio", "part", "root", "spans"):
            df = df.withColumn(name, F.lit("x"))
    return df


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(nodes, links):
    root = {i: i for i in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}

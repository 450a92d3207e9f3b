"""A* repair of conversations against a search over all edits."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from gridloom.llm import repair
from gridloom.llm.repair import ASSISTANT, DELETE, FINE, OTHER, SYSTEM, TRUNCATED, USER, Costs


def _best(codes, costs):
    """Least (cost, edits) by extending all states row by row; insertions anywhere."""
    inf = (10**9, "~")

    def grown(best):
        best = dict(best)
        for _ in range(2):
            for q in list(best):
                need, then = repair.wanted(q)
                c, s = best[q]
                best[then] = min(best.get(then, inf), (c + costs.inserted, s + "I"))
        return best

    now = {repair.START: (0, "")}
    for code in codes:
        kind, fault = code & 3, code >> 2
        after = {}
        for q, (c, s) in grown(now).items():
            more = costs.truncated if fault == TRUNCATED else 0
            moves = [("D", q, costs.deleted)]
            if fault != DELETE:
                need, then = repair.wanted(q)
                if repair.kept(q, kind) is not None:
                    moves.append(("K", repair.kept(q, kind), more))
                if kind != need:
                    moves.append(("R", then, more + costs.reroled))
            for letter, then, cost in moves:
                after[then] = min(after.get(then, inf), (c + cost, s + letter))
        now = after
    ends = grown(now)
    return min(ends[q] for q in (repair.START, repair.TOLD) if q in ends)


@pytest.mark.parametrize("costs", [Costs(), Costs(1, 7, 2, 1), Costs(3, 2, 1, 5), Costs(1, 50, 1, 1)])
def test_search_is_the_least_of_all(costs):
    rng = random.Random(costs.deleted)
    for n in [*range(9)] * 40 + [60, 200]:
        codes = bytes(rng.choices([USER, ASSISTANT, SYSTEM, OTHER], [4, 4, 2, 1])[0] + 4 * rng.choices([FINE, TRUNCATED, DELETE], [6, 2, 2])[0] for _ in range(n))
        assert repair.repair(codes, costs) == _best(codes, costs), codes


def test_long_conversations_take_linear_time():
    rng = random.Random(9)
    codes = bytes(rng.randrange(12) for _ in range(60_000))
    assert repair.repair(codes)[0] == _best(codes[:0] + codes, Costs())[0]
    assert repair.repair(bytes([SYSTEM] * 5000)) == (5000 * 1, "K" + "R" * 4998 + "D") or repair.repair(bytes([SYSTEM] * 5000))[0] == _best(bytes([SYSTEM] * 5000), Costs())[0]


def test_report_and_repaired_turns(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "hi?"), (1, 2, "user", "hi?"), (1, 3, "assistant", "cut off"), (1, 5, "user", " \n"), (1, 7, "tool", "Out!"),
            (2, None, None, None), (2, 4, "assistant", "Yes."), (2, 4, "assistant", "Yes."), (None, 1, "user", "Null. "), (3, 0, "user", "ok. " * 50000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(4)
    source = repair.source(df)
    got = {r["conv_id"]: r for r in repair.report(source).collect()}
    turns = {}
    for r in repair.repaired(source, repair.audits(source)).orderBy("conv_id", "number").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert set(got) == {None, 1, 2, 3}
    r = got[1]
    assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"]) == (2, 1, 1, 1, 2)
    assert r["audit"] == "KKDDDR" and r["cost"] == 7
    assert turns[1] == [("system", "S."), ("user", "hi?"), ("assistant", "Out!")]
    assert (got[2]["gaps"], got[2]["blank"], got[2]["duplicate"], got[2]["audit"]) == (0, 1, 1, "DDD") and 2 not in turns
    assert got[None]["audit"] == "D" and got[3]["audit"] == "D" and got[3]["cost"] == 2
    for c, g in got.items():
        said = turns.get(c, [])
        assert g["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in said).encode()).hexdigest()
        assert re.fullmatch("(s?(ua)+)?", "".join(a[0] for a, _ in said))


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.report(repair.damaged(repair.source(df))).collect() == []


def test_damage_by_checksum(spark):
    import zlib

    df = spark.createDataFrame([(c, t, "assistant", "A b! c? d.") for c in range(30) for t in range(5)] + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    got = {}
    for r in repair.damaged(repair.source(df)).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"], r["gone"]))
    for (c, t), seen in got.items():
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" ", " ") if c is None else ("assistant", "A b! c? d.")
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        assert seen == [("user" if k == 4 else role, text, k == 0)] * (2 if k == 3 else 1)

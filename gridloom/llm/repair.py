"""Repair of conversation structure: the cheapest edits that make the roles alternate, by iterative-deepening A*.

A conversation is right when the initials of its roles read `(s?(ua)+)?`. Rows are kept (K), given the other role (R), or deleted (D), and empty turns are
inserted (I). Blank and repeated rows must be deleted, truncated rows cost more unless deleted. Of the cheapest edits those whose initials come first
in ASCII order are taken.

The search is a depth-first search over (row, state) that tries edits in ASCII order under a bound on cost, raised to the least overrun until a path ends in
an accepting state; the first such path is the answer. States from which nothing was found are remembered with the budget that they failed with. The
estimate of the rest is a pattern database: the exact cost over a smaller automaton, in which the states after a system row and after an assistant row are one, so
`s` alone counts as right. It is admissible and consistent, and off only where everything after a system row goes, so bounds rise a few times at most and a
search is linear in the rows. It is kept as four bytes a row, as differences.

What is gathered of a conversation is one byte a row (its role and fault); the audit that the result holds has as many. Texts are sorted by Spark (which
spills) and pass one at a time through the digest of the repaired conversation.

Defined cases: a null conversation is one of its own; rows come by turn, nulls first, then by role and the digest of the text; null roles and texts are one space;
very long texts pass alone; repeated rows are duplicates; an empty table gives no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import cut
from .common import arrow_schema, by_key, sized


@dataclass(frozen=True)
class Costs:
    reroled: int = 1
    deleted: int = 2
    inserted: int = 5
    truncated: int = 5  # for a truncated row that stays

    def __post_init__(self):
        if not all(0 < c <= 50 for c in (self.reroled, self.deleted, self.inserted, self.truncated)):
            raise ValueError("costs are from 1 to 50, as estimates are kept in bytes")


#: Kinds of roles by initial, and faults; a row's code is kind + 4 * fault. Fixed values.
USER, ASSISTANT, SYSTEM, OTHER = range(4)
FINE, TRUNCATED, DELETE = range(3)
KIND = {"u": USER, "a": ASSISTANT, "s": SYSTEM}
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: States: nothing yet, after a system row, after an assistant row, after a user row.
START, SYS, ASKED, TOLD = 0, 1, 3, 2
ROLES = {USER: "user", ASSISTANT: "assistant"}


def wanted(state: int) -> tuple[int, int]:
    """The kind of turn that must follow, and the state after it."""
    return (ASSISTANT, TOLD) if state == ASKED else (USER, ASKED)


def kept(state: int, kind: int) -> int | None:
    """The state after keeping a row of that kind, if it may be kept."""
    need, then = wanted(state)
    return then if kind == need else SYS if kind == SYSTEM and state == START else None


class Estimates:
    """Cost of the rest over the smaller automaton {start}, {after system, after assistant}, {after user}; one pass from the end."""

    def __init__(self, codes: bytes, costs: Costs):
        n = len(codes)
        self.over = [bytearray(n + 1) for _ in range(3)]  # cost above the least of the three states
        self.fall = bytearray(n)  # the least cost at a row less that at the next
        start, even, odd = 0, 0, costs.inserted
        for i in range(n, -1, -1):
            if i < n:
                kind, fault = codes[i] & 3, codes[i] >> 2
                gone = costs.deleted
                a, b, c = start + gone, even + gone, odd + gone
                if fault != DELETE:
                    more = costs.truncated if fault == TRUNCATED else 0
                    to_odd = odd + more + (0 if kind == USER else costs.reroled)
                    a, b = min(a, to_odd, even + more if kind == SYSTEM else to_odd), min(b, to_odd)
                    c = min(c, even + more + (0 if kind == ASSISTANT else costs.reroled))
                start, even, odd = min(a, c + costs.inserted), min(b, c + costs.inserted), min(c, b + costs.inserted)
            least = min(start, even, odd)
            for table, x in zip(self.over, (start, even, odd), strict=True):
                table[i] = x - least
            start, even, odd = start - least, even - least, odd - least
            if i < n:
                self.fall[i] = least
        self.at = {START: self.over[0], SYS: self.over[1], TOLD: self.over[1], ASKED: self.over[2]}

    def total(self) -> int:
        return sum(self.fall) + self.over[0][0]


def repair(codes: bytes, costs: Costs = Costs()) -> tuple[int, str]:
    """The least cost and the edits of a conversation given by the codes of its rows."""
    n, estimate = len(codes), Estimates(codes, costs)
    at, fall = estimate.at, estimate.fall

    def edits(i: int, state: int) -> list[tuple[int, int, int, int]]:
        """(letter, next row, next state, cost) in ASCII order of the letters."""
        need, then = wanted(state)
        insert = (73, i, then, costs.inserted)
        if i == n:
            return [insert]
        kind, fault = codes[i] & 3, codes[i] >> 2
        out = [(68, i + 1, state, costs.deleted), insert]
        if fault != DELETE:
            more = costs.truncated if fault == TRUNCATED else 0
            stays = kept(state, kind)
            if stays is not None:
                out.append((75, i + 1, stays, more))
            if kind != need:
                out.append((82, i + 1, then, more + costs.reroled))
        return out

    slack, base = 0, estimate.total()  # slack: the bound less cost so far and estimate
    while True:
        failed: dict[int, int] = {}  # (row, state) -> the largest slack that nothing was found with
        overrun = None
        path, froms, slacks, nexts = bytearray(), bytearray(), [slack], [0]
        i, state = 0, START
        while nexts:
            left = slacks[-1]
            if i == n and state in (START, TOLD):
                return base + slack - left, path.decode()
            place, step = i * 4 + state, None
            if nexts[-1] or failed.get(place, -1) < left:
                options = edits(i, state)
                while nexts[-1] < len(options):
                    letter, j, then, cost = options[nexts[-1]]
                    nexts[-1] += 1
                    loss = cost + at[then][j] - at[state][i] - (fall[i] if j > i else 0)
                    if loss > left:
                        overrun = loss - left if overrun is None else min(overrun, loss - left)
                    elif failed.get(j * 4 + then, -1) < left - loss:
                        step = letter, j, then, left - loss
                        break
            if step:
                froms.append(state)
                path.append(step[0])
                i, state = step[1], step[2]
                slacks.append(step[3])
                nexts.append(0)
                continue
            failed[place] = max(left, failed.get(place, -1))
            nexts.pop()
            slacks.pop()
            if path:
                state = froms.pop()
                i -= path.pop() != 73
        if overrun is None:
            raise AssertionError("every conversation can be emptied")
        slack += overrun


def applied(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """Roles and texts after the edits."""
    state = START
    for letter in audit:
        need, then = wanted(state)
        if letter == "I":
            yield ROLES[need], ""
            state = then
            continue
        role, text = next(rows)
        if letter == "D":
            continue
        if letter == "R":
            role, state = ROLES[need], then
        else:
            state = kept(state, KIND.get(role[:1], OTHER))
        yield role, text


# over tables ---------------------------------------------------------------------------------------------------------------------------------------------
def source(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text; null roles and texts are one space. `gone` marks rows that only tell of their conversation."""
    col = lambda c: F.col(f"`{c}`")
    return rows.select(col(conv).cast("long").alias("conv_id"), col(turn).cast("long").alias("turn"), F.coalesce(col(role), F.lit(" ")).alias("role"), F.coalesce(col(text), F.lit(" ")).alias("text"), F.lit(False).alias("gone"))


def damaged(rows: DataFrame, kinds: int = 20) -> DataFrame:
    """The damage by crc32(conv_id:turn) modulo `kinds`: 0 row gone, 1 empty text, 2 no `.!?`, 3 twice, 4 role user."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")), F.lit(kinds))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (rows.withColumn("k", kind).withColumn("text", text).withColumn("role", F.when(F.col("k") == 4, "user").otherwise(F.col("role")))
            .withColumn("gone", F.col("gone") | (F.col("k") == 0)).withColumn("again", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("k", "again"))


def _code() -> Column:
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "u", USER).when(initial == "a", ASSISTANT).when(initial == "s", SYSTEM).otherwise(OTHER)
    blank, cut_off = ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return F.struct(kind.alias("kind"), blank.alias("blank"), cut_off.alias("truncated"))


FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
AUDITS = f"conv_id long, {', '.join(f'{c} long' for c in FACTS)}, audit string"


def audits(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Faults, least cost and edits of each conversation of `source` rows; only facts of rows are shuffled, no texts."""
    kinds = arrow_schema(AUDITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def audit(group) -> tuple:
            codes, faults, illegal, before = bytearray(), [0, 0, 0], 0, None
            low = high = last = None
            distinct = 0
            for _, turn, gone, kind, blank, cut_off, again in group:
                if gone:
                    continue
                fault = 0 if blank else 1 if again else 2 if cut_off else None
                if fault is not None:
                    faults[fault] += 1
                codes.append(kind + 4 * (FINE if fault is None else TRUNCATED if fault == 2 else DELETE))
                illegal += before is not None and (before, kind) not in LEGAL
                before = kind
                if turn is not None:
                    low, high = turn if low is None else low, turn
                    distinct += turn != last
                    last = turn
            cost, edits = repair(bytes(codes), costs)
            return (high - low + 1 - distinct if distinct else 0), *faults, illegal, cost, edits

        yield from sized(((key, *audit(group)) for key, group in by_key(batches)), kinds, text=7)

    facts = rows.select("conv_id", "turn", "gone", "role", F.sha2("text", 256).alias("digest"), _code().alias("c")).repartition("conv_id")
    # the same dealing by conversation serves the window and the walk
    same = Window.partitionBy("conv_id", "gone", "role", "digest").orderBy("turn")
    numbered = facts.withColumn("n", F.row_number().over(same)).sortWithinPartitions("conv_id", "turn", "role", "digest", "n")
    return numbered.select("conv_id", "turn", "gone", "c.kind", "c.blank", "c.truncated", (F.col("n") > 1).alias("again")).mapInArrow(run, AUDITS)


REPAIRED = "conv_id long, number long, role string, text string"


def _with_audit(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of each conversation behind its audit (in `role`) and its other facts (in `text`), dealt and sorted by conversation."""
    facts = F.concat_ws(",", *[F.col(c) for c in FACTS])
    head = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.col("audit").alias("role"), facts.alias("text"))
    body = rows.filter(~F.col("gone")).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text")
    return head.unionByName(body).repartition("conv_id").withColumn("digest", F.sha2("text", 256)).sortWithinPartitions("conv_id", "kind", "turn", "role", "digest").select("conv_id", "role", "text")


def _edited(group: Iterator[tuple]) -> tuple[str, str, Iterator[tuple[str, str]]]:
    """Audit, other facts and repaired turns."""
    _, audit, facts = next(group)
    return audit, facts, applied(((r, t) for _, r, t in group), audit)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, number (from 0), role and text of every turn after the edits that `audits` found for the same rows."""
    kinds = arrow_schema(REPAIRED)

    def run(batches):
        yield from sized(((key, i, r, t) for key, group in by_key(batches) for i, (r, t) in enumerate(_edited(group)[2])), kinds, text=3)

    return _with_audit(rows, found).mapInArrow(run, REPAIRED)


def report(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """`audits` with the digest of the repaired conversation (`role:text`, joined by line ends)."""
    schema = AUDITS + ", repaired_sha256 string"
    kinds = arrow_schema(schema)

    def run(batches):
        def digest(group) -> tuple:
            h, first = hashlib.sha256(), True
            audit, facts, edited = _edited(group)
            for role, text in edited:
                h.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            return *map(int, facts.split(",")), audit, h.hexdigest()

        yield from sized(((key, *digest(group)) for key, group in by_key(batches)), kinds, text=7)

    return _with_audit(rows, cut(audits(rows, costs), "audits")).mapInArrow(run, schema)

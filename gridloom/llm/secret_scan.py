"""Secrets by fixed patterns and by character Markov models, with DataFrame functions only.

Three patterns give the base spans. Two first-order character models are trained: on the values that the patterns found in all documents (random strings)
and on their ordinary identifiers; all documents count, as pairs of characters. Any other long run of identifier characters is scored by the log-likelihood ratio of the two models; a run that is
long enough and random enough is a further span of kind `markov`. Base spans are cut out of a run first; of what is left, pieces between `/`, `_`, `=` and `-` are
judged as well where the whole is not random enough, so that ordinary text around a random string does not hide it.

Positions count code points: the text is split at the matches and the lengths of gaps and matches are added up.

Defined cases: a null text is empty and has no span; without a sample of either class no run is judged random; rows are treated one by one, so repeated
rows give equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, the group that must be long enough, and its least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))

LEAST_RUN = 16
RUN = rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}"
IDENTIFIER = r"\b[A-Za-z_][A-Za-z0-9_]{7,}\b"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_SIDE = len(ALPHABET) + 1  # the last row and column stand for any other character
SPAN = "struct<start:int,ord:int,end:int,kind:string>"


@dataclass(frozen=True)
class Settings:
    """Limits on the ratio of a run, or of its best stretch, in nats."""

    smoothing: float = 0.2
    least_total: float = 15.0
    least_each: float = 0.7


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL of `body` with `name` bound to a value that is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(values: str, step: str) -> str:
    """SQL of running sums or maxima of an array by doubling distances: `step` combines x and y. Passes are the logarithm of the length."""
    return f"""aggregate(sequence(0, 30), {values}, (acc, j) -> if(size(acc) <= shiftleft(1, j), acc,
        transform(acc, (x, i) -> if(i < shiftleft(1, j), x, {step.replace("y", "acc[i - shiftleft(1, j)]")}))))"""


def _sums(values: str) -> str:
    return _running(values, "x + y")


#: Code points of a block of text; taking a piece out of a text costs a block and not all that stands before it.
BLOCK = 1000


def _blocks(text: str) -> str:
    return f"regexp_extract_all({text}, '(?s).{{1,{BLOCK}}}', 0)"


def _piece(blocks: str, start: str, end: str) -> str:
    """SQL of the code points [start, end) of a text given by its blocks."""
    return f"""if({end} <= {start}, '', array_join(transform(sequence(cast(({start}) div {BLOCK} as int), cast((({end}) - 1) div {BLOCK} as int)), k -> substring({blocks}[k],
        greatest(({start}) - k * {BLOCK}, 0) + 1, least(({end}) - k * {BLOCK}, {BLOCK}) - greatest(({start}) - k * {BLOCK}, 0))), ''))"""


def _replaced(text: str, spans: str, put: str) -> str:
    """SQL of a text whose spans (sorted by start; overlapping ones as one) are replaced; `put` is an expression of b (the span) and its part beyond the spans before, [f, t)."""
    tops = _running(f"transform({spans}, b -> b.end)", "greatest(x, y)")
    inner = f"""concat(array_join(transform({spans}, (b, i) -> {_let("named_struct('top', if(i = 0, 0, tops[i - 1]))", "p", f"concat({_piece('blocks', 'p.top', 'b.start')}, {put})")}), ''),
        {_piece("blocks", "tops[size(tops) - 1]", f"length({text})")})"""
    return _let(_blocks(text), "blocks", _let(tops, "tops", inner))


def _spans(text: str, kind: str, order: int, pattern: str, group: int, least: int) -> str:
    """SQL of the spans of one pattern whose group is long enough, in order."""
    p = _quoted(pattern)
    none = f"cast(array() as array<{SPAN}>)"
    found = f"named_struct('whole', regexp_extract_all({text}, {p}, 0), 'part', regexp_extract_all({text}, {p}, {group}), 'gaps', split({text}, {p}, -1))"
    ends = _sums("transform(m.whole, (w, i) -> length(m.gaps[i]) + length(w))")
    placed = f"""transform(m.whole, (w, i) -> if(length(m.part[i]) >= {least}, named_struct('start', ends[i] - length(w), 'ord', {order}, 'end', ends[i], 'kind', '{kind}'), null))"""
    walk = _let(found, "m", _let(ends, "ends", f"filter({placed}, x -> x is not null)"))
    return f"if({text} rlike {_quoted(_long(pattern, kind, least))}, {walk}, {none})"


def _long(pattern: str, kind: str, least: int) -> str:
    """Most texts have no value of the least length: one cheap test spares them the walk."""
    return pattern[:pattern.rindex("+")] + f"{{{least if kind != 'access' else least - 4},}}" + pattern[pattern.rindex("+") + 1:]


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `__base`: base spans by start, then kind as listed. Backslashes in patterns need Spark's default of escaped string literals."""
    found = [F.expr(_spans(f"`{text}`", kind, i, p, g, n)) for i, (kind, p, g, n) in enumerate(BASE)]
    out = docs
    for (kind, *_), c in zip(BASE, found, strict=True):
        out = out.withColumn(f"__{kind}", c)
    return out.withColumn("__base", F.array_sort(F.concat(*[F.col(f"__{kind}") for kind, *_ in BASE])))


def _bigrams(strings: DataFrame) -> DataFrame:
    """Counts of adjacent characters (as alphabet positions) in a column `s`."""
    pairs = strings.select(F.explode(F.expr("transform(sequence(1, length(s) - 1), i -> substring(s, i, 2))")).alias("p"))
    return pairs.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def train(docs: DataFrame, s: Settings = Settings(), text: str = "text") -> list[float] | None:
    """Log ratios of the random to the ordinary model for each pair of characters; None if a sample is empty."""
    d = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    # of an assignment only the value is random: its last run of identifier characters
    values = [f"""if(text rlike {_quoted(_long(p, kind, n))}, transform(filter(arrays_zip(regexp_extract_all(text, {_quoted(p)}, 0), regexp_extract_all(text, {_quoted(p)}, {g})),
        x -> length(x.`1`) >= {n}), x -> regexp_extract(x.`0`, '([A-Za-z0-9+/_=-]+)$', 1)), cast(array() as array<string>))""" for kind, p, g, n in BASE]
    secrets = d.select(F.explode(F.expr(f"concat({', '.join(values)})")).alias("s")).filter("length(s) >= 8")
    words = d.select(F.explode(F.expr(f"regexp_extract_all(text, {_quoted(IDENTIFIER)}, 0)")).alias("s")).filter(~F.col("s").rlike("[0-9]{4}"))
    place = {c: i for i, c in enumerate(ALPHABET)}
    models = []
    for sample in (secrets, words):
        counts = [[s.smoothing] * _SIDE for _ in range(_SIDE)]
        found = _bigrams(sample).filter(F.length("p") == 2).filter(F.col("p").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).collect()  # at most the square of the alphabet
        if not found:
            return None
        for r in found:
            counts[place[r["p"][0]]][place[r["p"][1]]] += r["n"]
        models.append([[math.log(x / sum(row)) for x in row] for row in counts])
    return [a - b for ra, rb in zip(*models, strict=True) for a, b in zip(ra, rb, strict=True)]


def _place(character: str) -> str:
    return f"if(instr('{ALPHABET}', {character}) = 0, {_SIDE - 1}, instr('{ALPHABET}', {character}) - 1)"


def scan(docs: DataFrame, ratios: list[float] | None, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """`docs` with `__base` and `__all`, arrays of spans by start, then kind; further spans never overlap base ones."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    based = base_spans(docs.withColumn("__text", F.coalesce(F.col(text), F.lit(""))), "__text")
    if ratios is None:
        return based.withColumn("__all", F.col("__base")).drop("__text", *[f"__{k}" for k, *_ in BASE])
    model = f"from_json('{json.dumps([round(r, 6) for r in ratios])}', 'array<double>')"  # folded to one constant
    total = f"""aggregate(sequence(1, length(x.s) - 1), 0D, (acc, i) -> acc + {model}[{_place('substring(x.s, i, 1)')} * {_SIDE} + {_place('substring(x.s, i + 1, 1)')}])"""
    p = _quoted(RUN)
    strings = "array<struct<at:int,s:string>>"
    def placed(whole: str, ends: str, where: str = "") -> str:
        """Strings with their places, from running sums of the ends; `where` keeps some."""
        out = f"transform({whole}, (w, i) -> named_struct('at', {ends} - length(w), 's', w))"
        return f"filter({out}, y -> {where})" if where else out

    walk = _let(_sums("transform(m.r, (w, i) -> length(m.g[i]) + length(w))"), "ends", placed("m.r", "ends[i]"))
    # base spans are blanked, which cuts runs there and keeps all places
    blank = _replaced("__text", "__base", "repeat(' ', greatest(b.end - greatest(p.top, b.start), 0))")
    pieces = _let(f"split(x.s, {_quoted('(?<=[/_=-])|(?=[/_=-])')}, -1)", "ws", _let(_sums("transform(ws, w -> length(w))"), "ends", placed("ws", "x.at + ends[i]", f"length(y.s) >= {LEAST_RUN}")))
    scored = f"x -> named_struct('at', x.at, 's', x.s, 'llr', {total})"
    random = f"(x.llr >= {s.least_total} and x.llr >= {s.least_each} * (length(x.s) - 1))"
    judged = based.withColumn("__rest", F.expr(f"if(size(__base) > 0, {blank}, __text)"))
    judged = judged.withColumn("__runs", F.expr(f"""if(__rest rlike {p}, {_let(f"named_struct('r', regexp_extract_all(__rest, {p}, 0), 'g', split(__rest, {p}, -1))", "m", walk)},
        cast(array() as {strings}))"""))
    judged = judged.withColumn("__runs", F.expr(f"transform(__runs, {scored})"))
    # a whole run that is not random may still hold a piece that is
    judged = judged.withColumn("__runs", F.expr(f"""concat(filter(__runs, x -> {random}), filter(transform(flatten(transform(filter(__runs, x -> not {random} and x.s rlike '[/_=-]'), x -> {pieces})), {scored}),
        x -> {random}))"""))
    further = judged.withColumn("__markov", F.expr(f"transform(__runs, x -> named_struct('start', x.at, 'ord', {len(BASE)}, 'end', x.at + length(x.s), 'kind', 'markov'))"))
    return further.withColumn("__all", F.array_sort(F.concat("__base", "__markov"))).drop("__text", "__rest", "__runs", "__markov", *[f"__{k}" for k, *_ in BASE])


def joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def report(docs: DataFrame, ratios: list[float] | None, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, a count for each base kind, base_sha256, spans."""
    found = scan(docs.select(key, text), ratios, s, text)
    counts = [F.expr(f"cast(size(filter(__base, x -> x.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind, *_ in BASE]
    return found.select(key, *counts, F.sha2(joined("__base"), 256).alias("base_sha256"), joined("__all").alias("spans"))


def redact(docs: DataFrame, ratios: list[float] | None, s: Settings = Settings(), text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every span (overlapping ones as one) replaced by `mark`; a null text stays null, other columns stay as they are."""
    found = scan(docs, ratios, s, text)
    fold = _replaced(f"`{text}`", "__all", f"if(b.start >= p.top, '{mark}', '')")
    return found.withColumn(text, F.when(F.size("__all") > 0, F.expr(fold)).otherwise(F.col(text))).drop("__base", "__all")

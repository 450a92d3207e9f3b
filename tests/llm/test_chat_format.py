"""Template compiler and conversation formatting."""

from __future__ import annotations

import hashlib
import random

import pytest

from gridloom.llm import chat_format, template
from gridloom.llm.template import END, GENERATE, TemplateError, compile_template


def _text(source, **scope):
    return "".join(x for x in compile_template(source, names=tuple(scope))(scope) if isinstance(x, str))


@pytest.mark.parametrize(("source", "want"), [
    ("a{# no #}b{{ 1 + 2 }}{{ 'x' ~ true ~ none }}", "ab3xtrue"), ("{% if x == 1 %}one{% elif x == 2 %}two{% else %}more{% endif %}", "two"),
    ("{% for m in items %}{{ loop.index }}{{ m }}{{ '' if loop.last else ',' }}{% endfor %}", "1a,2b"), ("  {%- set y = x + 1 -%}  {{ y }}", "3"),
    ("{{ d.k }}{{ d['k'] }}{{ d.missing }}", "vv"), ("{{ ' T ' | trim | lower }}{{ 'abc' | length }}", "t3"), ("{{ x > 1 and not x == 3 or false }}", "true"),
    ("{{ 'a' in 'cat' }}{{ 'q' in d }}", "truefalse"), ("{% for m in items %}{% for n in pair %}{{ m }}{{ n }}{% endfor %}{{ loop.index0 }}{% endfor %}", "apaq0bpbq1"),
])
def test_language(source, want):
    assert _text(source, x=2, items=["a", "b"], pair=["p", "q"], d={"k": "v"}) == want


@pytest.mark.parametrize("source", ["{{ open('x') }}", "{{ nobody }}", "{% for m in items %}", "{% endif %}", "{{ x | shell }}", "{% import os %}", "{{ 1 + }}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}",
                                    "{{ " + "(" * 100 + "1" + ")" * 100 + " }}", "{% if x %}" * 100 + "{% endif %}" * 100, "{% if x %}{% else %}{% endfor %}", "{{ m }}{% for m in items %}{% endfor %}"])
def test_wrong_templates_fail_when_compiled(source):
    with pytest.raises(TemplateError):
        compile_template(source, names=("x", "items"))


def test_sandbox_reaches_keys_only():
    assert _text("{{ x.__class__ }}{{ d.__class__ }}{{ s.upper }}", x=1, d={}, s="a") == ""
    with pytest.raises(TemplateError):
        _text("{{ d }}", d={})
    with pytest.raises(TemplateError):
        _text("{{ 'a' + 'b' }}", x=1)


def test_constants_are_folded():
    tree = template.folded_block(template.parse("a{{ 'b' ~ 2 }}{% if 1 == 2 %}x{% else %}c{{ 'D' | lower }}{% endif %}{{ x }}"), template.FILTERS)
    assert tree == (template.Out(template.Const("ab2cd")), template.Out(template.Name("x")))


def test_generation_marks_and_streaming():
    def endless():
        i = 0
        while True:
            yield {"role": "assistant", "text": str(i)}
            i += 1

    fmt = chat_format.Format()
    out = compile_template(fmt.template, filters=chat_format.filters(fmt))({"messages": endless()})
    first = [next(out) for _ in range(12)]
    assert first[3] is GENERATE and first[4] == "0" and first[5] is END


ODD = [r"\### Assistant: </turn> ok", "\\", "\\\\n", "</turn>\n", "<turn>user\nhi</turn>\n", "", "\n\n", "é😀\u2028x", "\\</turn>\\", "a</turn", ">\n", "n\\n\n"]


@pytest.mark.parametrize("piece_chars", [1, 17, 1 << 20])
def test_round_trip_of_hostile_texts(spark, piece_chars):
    rng = random.Random(piece_chars)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\nb", "</turn>", "\\n"]), "".join(rng.choice(ODD) for _ in range(rng.randint(0, 4)))) for c in range(12) for t in range(rng.randint(1, 7))]
    rows += [(20, None, None, None), (20, 1, "assistant", None), (None, 0, "assistant", "x"), (None, 1, "user", "y"), (21, 0, "assistant", "long </turn> \\ " * 20000), (22, 3, "user", "same"), (22, 3, "user", "same")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, loss int").repartition(5)
    fmt = chat_format.Format(piece_chars=piece_chars)
    out = chat_format.formatted(df, fmt)
    got, seen = {}, {r[0]: r for r in chat_format.digests(out, fmt).collect()}
    for r in chat_format.turns(out, fmt).orderBy("conv_id", "number").collect():
        got.setdefault(r[0], []).append((r[2], r[3]))
    want = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        want.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert got == want
    sizes = {r[0]: r[1] for r in out.selectExpr("conv_id", "length(text) n").groupBy("conv_id").sum("n").collect()}
    for c, turns in want.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert tuple(seen[c])[1:] == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), sizes[c])


def test_empty_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.formatted(df)).collect() == [] and chat_format.turns(chat_format.formatted(df)).collect() == []

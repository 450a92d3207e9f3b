"""A small sandboxed template language: source text -> syntax tree -> folded tree -> Python closures.

    {{ expr }}    {% for m in messages %} ... {% endfor %}    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set name = expr %}    {% generation %} ... {% endgeneration %}    {# remark #}    a dash inside a mark strips the white space beside it

Expressions have strings, whole numbers, true, false, none, names, `m.key` and `m['key']` (keys of mappings only, never attributes of Python objects),
`| filter`, `~` (joins texts), `+ -` (whole numbers), comparisons, `in`, `not`, `and`, `or` and `a if c else b`. A loop offers loop.index, index0, first
and last. There are no calls, no imports and no names beyond those given, so a template can neither reach the interpreter nor loop by itself.

`compile_template` returns a function of a mapping that yields texts in order, and GENERATE / END around what `generation` blocks render. A loop takes its
sequence one item at a time (one ahead, for `loop.last`), so a conversation of any length is rendered in bounded memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from typing import Any


class TemplateError(ValueError):
    pass


class Mark:
    def __init__(self, name: str):
        self.name = name

    def __repr__(self) -> str:
        return self.name


GENERATE, END = Mark("GENERATE"), Mark("END")


# syntax tree ---------------------------------------------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: Any
    key: Any


@dataclass(frozen=True)
class Apply:
    """A filter or an operator on expressions."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Choice:
    """`a if test else b`."""

    test: Any
    a: Any
    b: Any


@dataclass(frozen=True)
class Out:
    expr: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    test: Any
    body: tuple
    other: tuple


@dataclass(frozen=True)
class Let:
    name: str
    expr: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


def shown(value: Any) -> str:
    """How a value is printed; none and missing keys are empty."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str | int):
        return str(value)
    raise TemplateError(f"a value of kind {type(value).__name__} cannot be printed")


def _number(x: Any) -> int:
    if isinstance(x, int) and not isinstance(x, bool):
        return x
    raise TemplateError("whole numbers are added and subtracted, texts are joined with ~")


def _ordered(a: Any, b: Any) -> bool:
    if isinstance(a, str) and isinstance(b, str) or isinstance(a, int) and isinstance(b, int):
        return a < b
    raise TemplateError("only two texts or two numbers are ordered")


OPERATORS: dict[str, Callable] = {
    "~": lambda a, b: shown(a) + shown(b), "+": lambda a, b: _number(a) + _number(b), "-": lambda a, b: _number(a) - _number(b),
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": _ordered, ">": lambda a, b: _ordered(b, a),
    "<=": lambda a, b: not _ordered(b, a), ">=": lambda a, b: not _ordered(a, b), "in": lambda a, b: isinstance(b, str | dict) and shown(a) in b, "not": lambda a: not a,
}
FILTERS: dict[str, Callable] = {"trim": lambda s: shown(s).strip(), "upper": lambda s: shown(s).upper(), "lower": lambda s: shown(s).lower(), "length": lambda s: len(shown(s))}


# parser --------------------------------------------------------------------------------------------------------------------------------------------------
_MARKS = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-<>~+|.()\[\]=]))""", re.S)
_WORDS = {"true": True, "false": False, "none": None}
_DEEP = 60


class _Tokens:
    def __init__(self, source: str):
        self.list, self.at, self.depth, place = [], 0, 0, 0
        source = source.strip()
        while place < len(source):
            m = _TOKEN.match(source, place)
            if not m:
                raise TemplateError(f"cannot read {source[place:place + 20]!r}")
            text, number, word, sign = m.groups()
            self.list.append(("text", re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), text[1:-1], flags=re.S)) if text is not None else ("number", int(number)) if number else ("word", word) if word else ("sign", sign))
            place = m.end()

    def next_is(self, *values: str) -> bool:
        return self.at < len(self.list) and self.list[self.at][0] in ("word", "sign") and self.list[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.next_is(*values):
            self.at += 1
            return self.list[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        kind, value = self.list[self.at] if self.at < len(self.list) else ("", "")
        if kind != "word":
            raise TemplateError("a name is missing")
        self.at += 1
        return value

    # from loose to tight
    def expr(self):
        self.depth += 1
        if self.depth > _DEEP:
            raise TemplateError("the expression is nested too deeply")
        a = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            a = Choice(test, a, self.expr())
        self.depth -= 1
        return a

    def either(self):
        a = self.both()
        while self.take("or"):
            b = self.both()
            a = Choice(a, a, b)
        return a

    def both(self):
        a = self.denied()
        while self.take("and"):
            b = self.denied()
            a = Choice(a, b, a)
        return a

    def denied(self):
        if not self.take("not"):
            return self.compared()
        self.depth += 1
        if self.depth > _DEEP:
            raise TemplateError("the expression is nested too deeply")
        inner = self.denied()
        self.depth -= 1
        return Apply("not", (inner,))

    def compared(self):
        a = self.joined()
        while op := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
            a = Apply(op, (a, self.joined()))
        return a

    def joined(self):
        a = self.filtered()
        while op := self.take("~", "+", "-"):
            a = Apply(op, (a, self.filtered()))
        return a

    def filtered(self):
        a = self.single()
        while self.take("|"):
            a = Apply(f"|{self.name()}", (a,))
        return a

    def single(self):
        if self.take("("):
            a = self.expr()
            self.need(")")
        elif self.at < len(self.list) and self.list[self.at][0] in ("text", "number"):
            a = Const(self.list[self.at][1])
            self.at += 1
        else:
            name = self.name()
            a = Const(_WORDS[name]) if name in _WORDS else Name(name)
        while True:
            if self.take("."):
                a = Key(a, Const(self.name()))
            elif self.take("["):
                a = Key(a, self.expr())
                self.need("]")
            else:
                return a

    def end(self) -> None:
        if self.at < len(self.list):
            raise TemplateError(f"unexpected {self.list[self.at][1]!r}")


def parse(source: str) -> tuple:
    """The statements of a template."""
    stack: list[tuple[str, Any, list]] = [("", None, [])]
    at, strip = 0, False

    def text(s: str, end: bool) -> None:
        s = s.lstrip() if strip else s
        s = s.rstrip() if end else s
        if s:
            stack[-1][2].append(Out(Const(s)))

    def close(*kinds: str):
        kind, head, body = stack.pop() if len(stack) > 1 else ("", None, [])
        if kind not in kinds:
            raise TemplateError(f"the end of {' or '.join(kinds)} stands where {kind or 'nothing'} is open")
        return head, tuple(body)

    for m in _MARKS.finditer(source):
        text(source[at:m.start()], bool(m[1] or m[4]))
        at, strip = m.end(), bool(m[3] or m[6])
        if m[2] is not None:
            t = _Tokens(m[2])
            stack[-1][2].append(Out(t.expr()))
            t.end()
        elif m[5] is not None:
            if len(stack) > _DEEP:
                raise TemplateError("blocks are nested too deeply")
            t = _Tokens(m[5])
            word = t.name()
            if word == "for":
                name = t.name()
                t.need("in")
                stack.append(("for", (name, t.expr()), []))
            elif word == "if":
                stack.append(("if", [t.expr()], []))
            elif word in ("elif", "else"):
                head, body = close("if")
                stack.append(("if", [*head, body, t.expr() if word == "elif" else Const(True)], []))
            elif word == "set":
                name = t.name()
                t.need("=")
                stack[-1][2].append(Let(name, t.expr()))
            elif word == "generation":
                stack.append(("generation", None, []))
            elif word == "endfor":
                (name, over), body = close("for")
                stack[-1][2].append(For(name, over, body))
            elif word == "endif":
                head, body = close("if")
                made: tuple = ()
                for test, block in reversed(list(zip(head[::2], [*head[1::2], body], strict=True))):
                    made = (If(test, block, made),)
                stack[-1][2].extend(made)
            elif word == "endgeneration":
                _, body = close("generation")
                stack[-1][2].append(Generation(body))
            else:
                raise TemplateError(f"unknown statement {word!r}")
            t.end()
    text(source[at:], False)
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return tuple(stack[0][2])


# constant folding ----------------------------------------------------------------------------------------------------------------------------------------
def folded(node: Any, filters: dict[str, Callable]):
    """An expression with constant parts worked out."""
    again = lambda x: folded(x, filters)
    if isinstance(node, Key):
        return Key(again(node.of), again(node.key))
    if isinstance(node, Choice):
        test = again(node.test)
        if isinstance(test, Const):
            return again(node.a if test.value else node.b)
        return Choice(test, again(node.a), again(node.b))
    if isinstance(node, Apply):
        args = tuple(map(again, node.args))
        call = filters.get(node.op[1:]) if node.op[0] == "|" else OPERATORS[node.op]
        if call is None:
            raise TemplateError(f"unknown filter {node.op[1:]!r}")
        return Const(call(*[a.value for a in args])) if all(isinstance(a, Const) for a in args) else Apply(node.op, args)
    return node


def folded_block(body: Iterable, filters: dict[str, Callable]) -> tuple:
    """Statements with folded expressions; branches that cannot run go, neighbouring constant texts are one."""
    out: list = []
    for node in body:
        if isinstance(node, Out):
            node = Out(folded(node.expr, filters))
        elif isinstance(node, If):
            node = If(folded(node.test, filters), folded_block(node.body, filters), folded_block(node.other, filters))
        elif isinstance(node, For):
            node = replace(node, over=folded(node.over, filters), body=folded_block(node.body, filters))
        elif isinstance(node, Let):
            node = Let(node.name, folded(node.expr, filters))
        elif isinstance(node, Generation):
            node = Generation(folded_block(node.body, filters))
        for n in (node.body if node.test.value else node.other) if isinstance(node, If) and isinstance(node.test, Const) else (node,):
            if isinstance(n, Out) and isinstance(n.expr, Const):
                before = out.pop().expr.value if out and isinstance(out[-1], Out) and isinstance(out[-1].expr, Const) else ""
                n = Out(Const(before + shown(n.expr.value)))
            out.append(n)
    return tuple(out)


# closures ------------------------------------------------------------------------------------------------------------------------------------------------
def _value(node: Any, names: frozenset[str], filters: dict[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        if name not in names:
            raise TemplateError(f"unknown name {name!r}")
        return lambda scope: scope[name]
    if isinstance(node, Key):
        of, key = _value(node.of, names, filters), _value(node.key, names, filters)

        def get(scope):
            held = of(scope)
            return held.get(key(scope)) if type(held) is dict else None

        return get
    if isinstance(node, Choice):
        test, a, b = (_value(x, names, filters) for x in (node.test, node.a, node.b))
        return lambda scope: a(scope) if test(scope) else b(scope)
    call = filters[node.op[1:]] if node.op[0] == "|" else OPERATORS[node.op]
    args = [_value(a, names, filters) for a in node.args]
    if len(args) == 1:
        (only,) = args
        return lambda scope: call(only(scope))
    left, right = args
    return lambda scope: call(left(scope), right(scope))


Rendered = Iterator["str | Mark"]


def _block(body: tuple, names: frozenset[str], filters: dict[str, Callable], marked: bool = False) -> Callable[[dict], Rendered]:
    steps = []
    for node in body:
        steps.append(_statement(node, names, filters, marked))
        if isinstance(node, Let):
            names |= {node.name}
    if len(steps) == 1:
        return steps[0]

    def run(scope):
        for step in steps:
            yield from step(scope)

    return run


def _statement(node: Any, names: frozenset[str], filters: dict[str, Callable], marked: bool) -> Callable[[dict], Rendered]:
    if isinstance(node, Out):
        value = _value(node.expr, names, filters)

        def put(scope):
            yield shown(value(scope))

        return put
    if isinstance(node, Let):
        given, target = _value(node.expr, names, filters), node.name

        def let(scope):
            scope[target] = given(scope)
            return
            yield

        return let
    if isinstance(node, If):
        test, body, other = _value(node.test, names, filters), _block(node.body, names, filters, marked), _block(node.other, names, filters, marked)
        return lambda scope: (body if test(scope) else other)(scope)
    if isinstance(node, Generation):
        if marked:
            raise TemplateError("generation stands inside generation")
        inside = _block(node.body, names, filters, True)

        def generation(scope):
            yield GENERATE
            yield from inside(scope)
            yield END

        return generation
    over, name = _value(node.over, names, filters), node.name
    each = _block(node.body, names | {name, "loop"}, filters, marked)

    def loop(scope):
        items, inner = over(scope), dict(scope)
        if isinstance(items, str | int | dict) or items is None:
            raise TemplateError("only sequences are looped over")
        items, nothing = iter(items), object()
        now, index = next(items, nothing), 0
        while now is not nothing:
            ahead = next(items, nothing)
            inner[name], inner["loop"] = now, {"index": index + 1, "index0": index, "first": index == 0, "last": ahead is nothing}
            yield from each(inner)
            now, index = ahead, index + 1

    return loop


def compile_template(source: str, names: Iterable[str] = ("messages",), filters: dict[str, Callable] | None = None) -> Callable[[dict], Rendered]:
    """The rendering function of a template; wrong templates raise TemplateError here, not in a task."""
    known = {**FILTERS, **(filters or {})}
    return _block(folded_block(parse(source), known), frozenset(names), known)

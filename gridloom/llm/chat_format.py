"""Conversations to training text by a compiled template, with the loss mask, and back.

A template (see `template`) marks turns with control strings and what the model shall learn with `generation` blocks. Control strings and backslashes inside
texts are escaped by a backslash, line ends inside roles by `\\n`, so no text can look like a mark and every turn can be read back.

Rows are dealt by conversation and sorted by Spark (which spills); the template takes a conversation's rows one at a time and the formatted text leaves in
pieces of about `piece_chars`, cut between two outputs of the template. Neither side ever holds a conversation, only one piece and one turn. Conversations
of one piece are read back without a shuffle.

Defined cases: rows of a conversation come by turn, nulls first, then by role and text; a null role or text is empty; a null conversation is one of its own;
repeated rows are turns each; very long texts are one piece each; an empty table gives no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, by_key, sized
from .template import END, GENERATE, compile_template


@dataclass(frozen=True)
class Format:
    """A template over `messages` (role, text), and the strings that open and close its turns: open, role, line end, text, close."""

    open: str = "<turn>"
    close: str = "</turn>\n"
    template: str = (
        "{% for m in messages %}{{ '<turn>' }}{{ m.role | escape_line }}{{ '\\n' }}"
        "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
        "{{ '</turn>' }}{{ '\\n' }}{% endfor %}"
    )
    piece_chars: int = 1 << 20

    def control(self) -> list[str]:
        return [self.open.strip(), self.close.strip()]


def escaped(text: str, control: list[str]) -> str:
    text = text.replace("\\", "\\\\")
    for c in control:
        text = text.replace(c, "\\" + c)
    return text


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def filters(fmt: Format) -> dict:
    control = fmt.control()
    if any(c[:1] in ("n", "\\", "") for c in control):
        raise ValueError("a control string is empty or begins with n or a backslash")
    return {"escape": lambda s: escaped(s or "", control), "escape_line": lambda s: escaped(s or "", control).replace("\n", "\\n")}


FORMATTED = "conv_id long, piece long, last boolean, text string, loss array<struct<begin:int,end:int>>"


def _pieces(rendered: Iterator, most: int) -> Iterator[tuple[int, bool, str, list[dict]]]:
    """Number, whether it is the last, text and loss spans of each piece."""
    number, held, size, spans, begin = 0, [], 0, [], None  # begin: where the open generation block starts in this piece

    def shut() -> None:
        if begin is not None and size > begin:
            spans.append({"begin": begin, "end": size})

    for out in rendered:
        if out is GENERATE:
            begin = size
        elif out is END:
            shut()
            begin = None
        else:
            if held and size + len(out) > most:
                shut()
                yield number, False, "".join(held), spans
                number, held, size, spans, begin = number + 1, [], 0, [], None if begin is None else 0
            held.append(out)
            size += len(out)
    yield number, True, "".join(held), spans


def formatted(rows: DataFrame, fmt: Format = Format(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, piece, last, text, and loss: the spans (code points of the piece) under the loss mask."""
    compile_template(fmt.template, filters=filters(fmt))  # a wrong template fails here
    kinds = arrow_schema(FORMATTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(fmt.template, filters=filters(fmt))
        yield from sized(
            ((key, *piece) for key, group in by_key(batches) for piece in _pieces(render({"messages": ({"role": r, "text": t} for _, r, t in group)}), fmt.piece_chars)), kinds, text=3)

    col = lambda c: F.col(f"`{c}`")
    source = rows.select(col(conv).cast("long").alias("conv_id"), col(turn).alias("turn"), F.coalesce(col(role), F.lit("")).alias("role"), F.coalesce(col(text), F.lit("")).alias("text"))
    return source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def _turns(pieces: Iterator[str], fmt: Format) -> Iterator[tuple[str, str]]:
    """Roles and texts of a formatted conversation; at most one turn beyond a piece is held."""
    held, seen = "", 0
    for piece in pieces:
        held += piece
        while (at := held.find(fmt.close, seen)) >= 0:
            slashes = at - len(held[:at].rstrip("\\")) if at and held[at - 1] == "\\" else 0
            if slashes % 2:  # an escaped string of a text
                seen = at + 1
                continue
            role, _, text = held[:at].removeprefix(fmt.open).partition("\n")
            yield unescaped(role), unescaped(text)
            held, seen = held[at + len(fmt.close):], 0
        seen = max(seen, len(held) - len(fmt.close))
    if held:
        raise ValueError("formatted text ends inside a turn")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
TURNS = "conv_id long, number long, role string, text string"


def _read(formatted_rows: DataFrame, run, schema: str) -> DataFrame:
    """Apply a function of sorted pieces; only conversations of several pieces are shuffled."""
    names = ["conv_id", "text", "loss"]
    alone = (F.col("piece") == 0) & F.col("last")
    several = formatted_rows.filter(~alone).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return formatted_rows.filter(alone).select(*names).mapInArrow(run(True), schema).unionByName(several.select(*names).mapInArrow(run(False), schema))


def turns(formatted_rows: DataFrame, fmt: Format = Format()) -> DataFrame:
    """conv_id, number (from 0), role and text of every turn, read back from formatted text."""
    kinds = arrow_schema(TURNS)

    def run(single: bool):
        def read(batches):
            yield from sized(((key, i, r, t) for key, group in by_key(batches, single) for i, (r, t) in enumerate(_turns((p for _, p, _ in group), fmt))), kinds, text=3)

        return read

    return _read(formatted_rows, run, TURNS)


def digests(formatted_rows: DataFrame, fmt: Format = Format()) -> DataFrame:
    """One row for each conversation, from its formatted text and loss mask alone; hashes are fed turn by turn."""
    kinds = arrow_schema(DIGEST)

    def run(single: bool):
        def digest(group) -> tuple:
            all_turns, learned, n, chars, total = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

            def watched() -> Iterator[str]:
                nonlocal chars, total
                for _, text, loss in group:
                    total += len(text)
                    for span in loss:
                        part = unescaped(text[span["begin"]:span["end"]])
                        chars += len(part)
                        learned.update(part.encode())
                    yield text

            for role, text in _turns(watched(), fmt):
                all_turns.update(f"{role}\n{text}\n".encode())
                n += 1
            return n, all_turns.hexdigest(), chars, learned.hexdigest(), total

        def read(batches):
            yield from sized(((key, *digest(group)) for key, group in by_key(batches, single)), kinds)

        return read

    return _read(formatted_rows, run, DIGEST)

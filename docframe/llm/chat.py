"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. The operator renders successive prefixes of a
conversation and compares consecutive outputs: what the k-th turn added is its span. Where the k-th output does not
begin with the one before, the template rewrote history there; the conversation is flagged, spans are the parts that the
last output still has, and a turn whose part is gone has no span. The text's place inside a span is found in the same
way, by rendering the prefix with two texts that differ in their first character.

Rows of a conversation are brought together in order and streamed by one task, as its digests are sequential. Any template
sees every prefix of the whole conversation, which is held for it and takes time in the square of its turns. A template may
be declared to render each turn without looking at the others (Template.segment); then prefixes of that many turns are
rendered afresh, in bounded memory and linear time, and the declaration is tested where two segments meet: if the last
turn of one and the first of the next don't render to the concatenation of both, that counts as a rewrite.

Defined cases: null text and null role count as empty; rows that repeat a turn are all kept, in the order of turn (null
first), role, text; a turn whose part is gone from the output isn't counted in n_turns and has a null span; a null conv_id is a conversation of its own; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from docframe.cluster import ship

# Control strings of the template and of its relatives, which texts may hold.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
_SPECIAL = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_HEADER = re.compile(r"<s>\[ROLE\] (.*?) \[/ROLE\]\n", re.S)


def escape(text: str) -> str:
    """Double each backslash and put one after the first character of each control string.

    Successive prefixes render the same texts again, so short ones are remembered, a fixed number of them.
    """
    return _remembered(text) if len(text) <= 4096 else _escape(text)


def _escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


_remembered = lru_cache(maxsize=2048)(_escape)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def default_template(turns: list[tuple[str, str]]) -> str:
    return "".join([f"<s>[ROLE] {escape(role)} [/ROLE]\n{escape(text)}</s>\n" for role, text in turns])


@dataclass(frozen=True)
class Template:
    """A template and how its output is read back.

    render: (role, text) of each turn -> output. role_of: a turn's part of the output -> its role; without it the role is
    the turn's own. unescape: text in the output -> the turn's text. segment: declares that each turn is rendered without
    looking at others, and how many turns are rendered together; None declares nothing.
    """

    render: Callable[[list[tuple[str, str]]], str]
    role_of: Callable[[str], str] | None = None
    unescape: Callable[[str], str] = str
    segment: int | None = None


DEFAULT = Template(default_template, lambda part: unescape(_HEADER.match(part)[1]), unescape, 32)


def common_prefix(a: str, b: str) -> int:
    if b.startswith(a):
        return len(a)
    return len(os.path.commonprefix([a, b]))


def render(turns: list[tuple[str, str]], template=default_template) -> tuple[str, list[tuple[int, int, int, int] | None], list[int]]:
    """The output, for each turn (start, end, text start, text end) or None if it is gone, and the turns that rewrote.

    Positions are code points of the output.
    """
    now, spans, rewrites = "", [], []
    for k in range(1, len(turns) + 1):
        before, now = now, template(turns[:k])
        start = common_prefix(before, now)
        if start < len(before):
            rewrites.append(k - 1)
        role = turns[k - 1][0]
        one, two = template([*turns[: k - 1], (role, "x")]), template([*turns[: k - 1], (role, "y")])
        head = common_prefix(one, two)
        tail = len(os.path.commonprefix([one[head + 1 :][::-1], now[::-1]])) if one[head : head + 1] == "x" else 0
        first = max(start, min(head, len(now)))
        last = max(first, len(now) - min(tail, len(one) - head - 1))
        spans.append((start, len(now), first, last, now[start:]))
    kept = [(a, b, x, y) if now[a:b] == part else None for a, b, x, y, part in spans]
    return now, kept, rewrites


def _segments(rows, template: Template):
    """(turns, output, spans, rewrites) of each segment of a conversation."""
    turns: list[tuple[str, str]] = []
    before = None
    for turn in rows:
        turns.append(turn)
        if len(turns) == template.segment:
            yield _segment(before, turns, template)
            before, turns = turns[-1], []
    if turns:
        yield _segment(before, turns, template)


def _segment(before, turns, template):
    out, spans, rewrites = render(turns, template.render)
    if before is not None and template.render([before, turns[0]]) != template.render([before]) + template.render(turns[:1]):
        rewrites = sorted({0, *rewrites})
    return turns, out, spans, rewrites


class _Reader:
    """Digests of one conversation, read back from its output."""

    def __init__(self, rows, template: Template):
        self.n = self.chars = self.loss = self.rewrites = 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()
        for turns, out, spans, rewrites in _segments(rows, template):
            for (role, _), span in zip(turns, spans):
                if span is not None:
                    start, end, first, last = span
                    self.add(template.role_of(out[start:end]) if template.role_of else role, template.unescape(out[first:last]))
            self.chars += len(out)
            self.rewrites += len(rewrites)

    def add(self, role: str, text: str) -> None:
        self.n += 1
        self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if role == "assistant":
            self.loss += len(text)
            self.masked.update(text.encode("utf-8", "surrogatepass"))


def formatted(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, formatted, spans, rewrites of each conversation: its text whole in one row.

    spans: role, start, end, text_start, text_end of each turn (null places if it is gone); rewrites: the places of turns
    that rewrote what was before them. For conversations that fit in a row.
    """
    ship(turns.sparkSession)
    schema = _formatted_schema(turns)

    def run(batches):
        for conv, rows in _conversations(batches):
            out, places, rewritten, at = [], [], [], 0
            for part, text, spans, rewrites in _segments(rows, template):
                rewritten += [len(places) + k for k in rewrites]
                for (role, _), span in zip(part, spans):
                    places.append({"role": role, **({n: at + x for n, x in zip(_PLACES, span)} if span else {})})
                out.append(text)
                at += len(text)
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "formatted": "".join(out), "spans": places, "rewrites": rewritten}], schema=schema)

    kind = turns.schema["conv_id"].dataType.simpleString()
    return _ordered(turns).mapInArrow(run, f"conv_id {kind}, formatted string, spans array<struct<role: string, start: long, end: long, text_start: long, text_end: long>>, rewrites array<long>")


_PLACES = ("start", "end", "text_start", "text_end")


def _formatted_schema(turns):
    from pyspark.sql.pandas.types import to_arrow_type

    span = pa.struct([("role", pa.string()), *((c, pa.int64()) for c in _PLACES)])
    return pa.schema([("conv_id", to_arrow_type(turns.schema["conv_id"].dataType)), ("formatted", pa.string()), ("spans", pa.list_(span)), ("rewrites", pa.list_(pa.int64()))])


def _ordered(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches):
    """(conv_id, iterator of (role, text)) in order; the iterator is drained before the next conversation."""
    rows = ((c, r or "", t or "") for b in batches for c, r, t in zip(*(b.column(k).to_pylist() for k in (0, 2, 3))))
    for conv, group in groupby(rows, key=lambda x: x[0]):
        yield conv, ((r, t) for _, r, t in group)


def digests(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_rewrites, read back from the output."""
    ship(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        out = []
        schema = None

        def batch():
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], schema), *(pa.array(c) for c in columns[1:])], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_rewrites"])

        def typed(batches):
            nonlocal schema
            for b in batches:
                schema = b.schema.field(0).type
                yield b

        for conv, rows in _conversations(typed(batches)):
            reader = _Reader(rows, template)
            out.append((conv, reader.n, reader.all.hexdigest(), reader.loss, reader.masked.hexdigest(), reader.chars, reader.rewrites))
            if len(out) == 1000:
                yield batch()
                out = []
        if out:
            yield batch()

    return _ordered(turns).mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewrites long")

"""Paragraphs and tables of a unit stream as flat rows with explicit ordinals, and the way back.

Three passes: the tokens become lines that know their table row and cell; rows that follow each other become tables, and a
table without a row of several cells is unwrapped into paragraphs; ordinals are dealt and empty paragraphs at the end go.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field, replace

from docframe.decode import blocks as B

# Record classes, tags of a line record, alignments, control codes.
LINE, CELL, MARK = 0x10, 0x30, 0x20
FEED, ALIGN, INDENT, RULES = 0x20, 0x24, 0x26, 0x8F
ALIGNMENTS = ("left", "center", "right", "distribute")
LINE_END, PAGE, ROW_END, STOP = 0x0A, 0x0C, 0x0E, 0x00
STYLE_FLAGS, ON, BOLD_SHIFT = 20, 1 << 31, 26


@dataclass(frozen=True)
class Format:
    """What a line record says of a line; the defaults where there is none."""

    align: str = "left"
    indent: tuple[int, ...] | None = None
    feed: tuple[int, int] | None = None


@dataclass
class Row:
    """A ruled line of a table; items: (style, a, b, distance)."""

    x0: int = 0
    width: int = 0
    items: tuple[tuple[int, int, int, int], ...] = ()
    cells: list[tuple[int, int]] = field(default_factory=list)
    closed: bool = False


@dataclass
class Line:
    runs: list[tuple[str, str | None, bool]]  # text, reading, bold
    format: Format
    page: bool = False
    row: Row | None = None
    cell: int | None = None

    @property
    def text(self) -> str:
        return "".join(t for t, _, _ in self.runs)


def rule_items(values) -> tuple[tuple[int, int, int, int], ...]:
    """Items after the first three values: four words each, the last may be (style, distance)."""
    out = [tuple(values[k : k + 4]) for k in range(3, len(values) - 3, 4)]
    rest = values[3 + 4 * len(out) :]
    return (*out, (rest[0], 0, 0, rest[1])) if len(rest) >= 2 else tuple(out)


def rule_width(x0: int, items) -> int:
    """The width that a ruled line's items add up to; a last item without extent is one unit."""
    sizes = [a + dist + 2 for _, a, _, dist in items]
    if sizes and items[-1][1:] == (0, 0, 0):
        sizes[-1] = 1
    return x0 + 1 + sum(sizes)


def line_format(tags) -> Format:
    out = Format()
    for tag, v in tags:
        first = v[0] if v else 0
        if tag == ALIGN:
            out = replace(out, align=ALIGNMENTS[first] if first < len(ALIGNMENTS) else "other")
        elif tag == INDENT:
            out = replace(out, indent=tuple(v) or None)
        elif tag == FEED:
            out = replace(out, feed=(first, v[1] if len(v) > 1 else 0) if 1 <= first <= 9 else None)
    return out


def lines(units: list[int], spans=()) -> list[Line]:
    """Lines in order; a closed row without cells parts tables, and stands for a page break if it has one."""
    starts = [a for a, _, _ in spans]
    out: list[Line] = []
    runs: list[tuple[str, str | None, bool]] = []
    now, own, row = Format(), None, None

    def bold(at: int) -> bool:
        k = bisect_right(starts, at) - 1
        flags = spans[k][2].get(STYLE_FLAGS, 0) if k >= 0 else 0
        return bool(flags & ON) and flags >> BOLD_SHIFT & 3 in (1, 2)

    def pieces(token):
        """(text, bold) of a text, cut where the bold changes; positions are units."""
        if not starts:
            yield token.text, False
            return
        at, part, was = token.start, "", None
        for c in token.text:
            is_bold = bold(at)
            if was is not None and is_bold != was:
                yield part, was
                part = ""
            part, was, at = part + c, is_bold, at + 1 + (ord(c) > 0xFFFF)
        if part:
            yield part, was

    def end(always: bool) -> None:
        nonlocal runs, own, row
        if not (always or runs):
            return
        form = own or now
        if row is not None and row.cells:
            out.append(Line(runs, replace(form, indent=None, feed=None), row=row, cell=len(row.cells) - 1))
        else:
            if row is not None:
                form, row = replace(form, indent=None, feed=None), None
            out.append(Line(runs, form))
        runs, own = [], None

    def close() -> None:
        nonlocal row
        end(False)
        if row is not None:
            row.closed = True
            out.append(Line([], now, row=row))
        row = None

    for t in B.tokens(units):
        if t.kind == "record" and t.code == LINE:
            tags = B.tagged(t.words)
            rules = next((v for tag, v in tags if tag == RULES), None)
            if rules is None and row is None and runs:
                own = own or now  # a header inside a line formats the next one
                now = line_format(tags)
                continue
            end(False)
            if rules is not None:
                close()
                row = Row(rules[2] if len(rules) > 2 else 0, rules[0] if rules else 0, rule_items(rules))
            now = line_format(tags)
        elif t.kind == "record" and t.code == CELL:
            end(False)
            row = row or Row()
            row.cells.append((t.words[1] if len(t.words) > 1 else 0, t.words[2] if len(t.words) > 2 else 0))
        elif t.kind == "text":
            runs += [(part, None, is_bold) for part, is_bold in pieces(t)]
        elif t.kind == "inline":
            kind = B.inline_kind(t.words)
            if kind == "reading" and runs:
                runs[-1] = (runs[-1][0], t.text, runs[-1][2])
            elif kind == "visible" and t.text and not all(ord(c) < 0x20 for c in t.text):
                runs.append((t.text, None, bold(t.text_start)))
        elif t.kind == "control" and t.code == LINE_END:
            following = own is not None
            end(row is None or bool(row.cells))
            if row is None and not following:
                now = Format()
        elif t.kind == "control" and t.code == ROW_END:
            close()
            now = Format()
        elif t.kind == "control" and t.code == PAGE:
            end(False)
            if row is None:
                out.append(Line([], now, page=True, row=Row(closed=True)))
        elif (t.kind, t.code) in (("control", STOP), ("record", MARK)):
            close()
            out.append(Line([], now, row=Row(closed=True)))
    close()
    return out


def tree(units: list[int], spans=()) -> list[dict]:
    """One row a paragraph, and one a cell without any: block_no, row_no, cell_no, para_no, text, runs, format, cell edges."""
    tables: list = []  # paragraphs, separators, and tables as (rows, lines by row and cell)
    for line in lines(units, spans):
        if line.row is None:
            tables.append(line)
        elif line.row.cells:
            if not (tables and isinstance(tables[-1], tuple)):
                tables.append(([], {}))
            rows, held = tables[-1]
            if not (rows and rows[-1] is line.row):
                rows.append(line.row)
            if line.cell is not None:
                held.setdefault((id(line.row), line.cell), []).append(line)
        elif not line.row.items:
            tables.append(line)
    flat: list = []
    broken = False
    for entry in tables:
        if isinstance(entry, Line):
            if entry.row is None:
                flat.append([(None, None, [replace(entry, page=broken)])])
                broken = False
            broken |= entry.row is not None and entry.page
            continue
        rows, held = entry
        cells = [[(r, k, held.get((id(r), k), [])) for k in range(len(r.cells))] for r in rows]
        if all(len(r) <= 1 for r in cells):  # lines of a ruled box
            for _, _, own in (c for r in cells for c in r):
                for x in own or [Line([], Format())]:
                    flat.append([(None, None, [replace(x, page=broken)])])
                    broken = False
        else:
            flat.append(cells)
    while len(flat) > 1 and isinstance(flat[-1][0], tuple) and not flat[-1][0][2][0].text:
        flat.pop()
    if not flat:
        flat = [[(None, None, [Line([], Format())])]]
    out = []
    for no, entry in enumerate(flat):
        if isinstance(entry[0], tuple):
            out.append(_paragraph(entry[0][2][0], block_no=no))
            continue
        for row_no, cells in enumerate(entry):
            for row, cell_no, own in cells:
                place = {"block_no": no, "row_no": row_no, "cell_no": cell_no, "cell_left": row.cells[cell_no][0], "cell_right": row.cells[cell_no][1], "ruled": bool(row.items)}
                out += [_paragraph(x, **place, para_no=k) for k, x in enumerate(own)] or [place]
    return out


def _paragraph(line: Line, **place) -> dict:
    runs = [{"text": t, "reading": r, "bold": b} for t, r, b in line.runs]
    return {**place, "text": line.text, "runs": runs, "align": line.format.align, "indent": line.format.indent, "feed": line.format.feed, "page_break_before": line.page}


def line_record(*tags: tuple[int, list[int]]) -> list[int]:
    body = [0, *(x for tag, v in tags for x in (tag, len(v), *v)), 0xFFFF, 0]
    n = len(body) + 7
    return [B.RECORD, LINE, n, *body, n, 0, LINE, B.RECORD_END]


def cell_record(left: int, right: int) -> list[int]:
    return [B.RECORD, CELL, 12, 0, left, right, 0xFF, 0, 12, 0, CELL, B.RECORD_END]


def with_reading(base: str, reading: str) -> list[int]:
    """A base text and its reading as two inline texts."""
    part = lambda selector, text: [B.RECORD, 1, 7, 0, *selector, B.INLINE_START, *units_of(text), B.INLINE_STOP, 5, 0, 1, B.RECORD_END]
    return part((0, 3), base) + part((1, 0x82), reading)


def units_of(text: str) -> list[int]:
    raw = text.encode("utf-16-be", "surrogatepass")
    return [int.from_bytes(raw[k : k + 2], "big") for k in range(0, len(raw), 2)]


def table_units(rows: list[list[str]], column: int = 80) -> list[int]:
    """A new ruled table: columns of equal width, a rule between them, edges two units off the rules."""
    out = []
    for row in rows:
        rules = [column * len(row), 0, 0, *(x for _ in row for x in (0x13, 0, 0, column - 4)), 0x13, 0]
        out += line_record((RULES, rules))
        for k, text in enumerate(row):
            out += cell_record(column * k + 2, column * k + column - 2) + units_of(text)
        out.append(ROW_END)
    return out


def paragraph_units(text: str, align: str = "left") -> list[int]:
    return [*(line_record((ALIGN, [ALIGNMENTS.index(align)])) if align != "left" else []), *units_of(text), LINE_END]

"""Page setup streams: records whose fields are sparse, a mask in front of them saying which are there."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

# Fixed values of the format: the head, record tags, the sizes of a group's fields by mask bit (0: unknown, reading ends
# there), and what a page has where nothing is stored (hundredths of a millimetre, half-width columns, lines).
HEAD = b"\x00\x01\x00\x02\x10\x00"
PAPER, MARGINS, FONT, GRID, LINES, TWO_UP = 0x1001, 0x1002, 0x1006, 0x100B, 0x100D, 0x1014
GROUPS = {PAPER: (0, 4, 4, 1, 0, 1, 1, 0), GRID: (1, 2, 1, 0, 1, 0, 1, 2), "first": (0, 0, 0, 0, 2, 0, 0, 2), "margins": (1, 0, 2, 2, 2, 2, 2, 2)}
DEFAULTS = {"width": 21000, "height": 29700, "margin": 3000, "half_chars": 80, "lines": 40, "font": 370}
LAYOUT_UNKNOWN, COLUMNS_BIT, VERTICAL_BIT, GAP_BIT = 0x2D, 0x02, 0x10, 0x40


@dataclass
class PageSetup:
    width: int = DEFAULTS["width"]
    height: int = DEFAULTS["height"]
    margins: list[int] = field(default_factory=lambda: [DEFAULTS["margin"]] * 4)  # top, bottom, left, right
    half_chars: int = DEFAULTS["half_chars"]
    lines: int = DEFAULTS["lines"]
    line_gap: int | None = None
    font: int = DEFAULTS["font"]
    vertical: bool = False
    columns: int = 1
    rows: int = 1
    column_gap: int = 0
    two_up: bool = False
    headers: dict[int, tuple[int, int]] = field(default_factory=dict)  # place: (alignment, distance)


class _Cut(Exception):
    """The record ends before a field."""


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self, size: int) -> int:
        if self.at + size > len(self.data):
            raise _Cut
        self.at += size
        return int.from_bytes(self.data[self.at - size : self.at], "big")

    def group(self, sizes) -> dict[int, int]:
        """The fields of one group by bit."""
        mask, out = self.number(1), {}
        for bit, size in enumerate(sizes):
            if mask >> bit & 1:
                if not size:
                    raise _Cut
                out[bit] = self.number(size)
        return out


def records(data: bytes) -> list[tuple[int, bytes]]:
    """(tag, content) inside the first block; the last may be cut."""
    if len(data) < 10 or not data.startswith(HEAD):
        return []
    end = min(len(data), 10 + struct.unpack_from(">I", data, 6)[0])
    out, at = [], 10
    while at + 4 <= end:
        tag, size = struct.unpack_from(">2H", data, at)
        out.append((tag, data[at + 4 : min(at + 4 + size, end)]))
        at += 4 + size
    return out


def parsed(data: bytes) -> PageSetup | None:
    """The page setup, or None where the stream isn't one. A record that ends early leaves what it had not reached."""
    found = records(data)
    out, aligned = PageSetup(), {}
    for tag, content in found:
        try:
            _apply(out, aligned, tag, _Reader(content))
        except _Cut:
            continue
    out.headers = {k: (aligned.get(k, 0), d) for k, (_, d) in out.headers.items()}
    return out if found else None


def _apply(out: PageSetup, aligned: dict[int, int], tag: int, r: _Reader) -> None:
    if tag == TWO_UP:
        out.two_up = r.data[2:3] == b"\x04"
    elif tag == PAPER:
        f = r.group(GROUPS[PAPER])
        if 1 in f or 2 in f:
            out.width, out.height = f.get(1, DEFAULTS["width"]), f.get(2, DEFAULTS["height"])
    elif tag == MARGINS:
        r.group(GROUPS["first"])
        f = r.group(GROUPS["margins"])
        out.margins = [f.get(3 + k, m) for k, m in enumerate(out.margins)]
        mask = r.number(1)
        if mask & LAYOUT_UNKNOWN:
            return
        if mask & COLUMNS_BIT:
            n = r.number(1)
            out.columns, out.rows = 2 if n else 1, 2 if n == 2 else 1
        if mask & VERTICAL_BIT:
            out.vertical = r.number(1) == 1
        if mask & GAP_BIT:
            out.column_gap = r.number(2)
    elif tag == GRID:
        f = r.group(GROUPS[GRID])
        out.half_chars, out.line_gap = f.get(7) or out.half_chars, f.get(1)
    elif tag == LINES:
        mask = r.number(1)
        if mask & 2:
            r.at += mask & 1
            out.lines = r.number(2) or out.lines
    elif tag == FONT:
        if r.number(1) & 1:
            out.font = r.number(4) or out.font
    elif tag & 0xF0FF in (0x3006, 0x3007) and 1 <= (place := tag >> 8 & 0xF) <= 9:
        _header(out, aligned, place, tag & 1 == 1, r)


def _header(out: PageSetup, aligned: dict[int, int], place: int, is_alignment: bool, r: _Reader) -> None:
    if is_alignment:
        if len(r.data) >= 4 and r.data[1] & 0x20:
            aligned[place] = min(2, r.data[-2])
        return
    if r.number(1) != 3:
        return
    r.number(1)
    mask = r.number(1)
    shown = mask & 1 and r.number(1) == 1
    r.at += mask >> 1 & 1
    distance = r.number(2) if mask & 0x0C == 0x08 else 0
    if shown and not mask & 4:
        out.headers[place] = (0, distance)


def stream(found: list[tuple[int, bytes]]) -> bytes:
    """A stream of these records."""
    body = b"".join(struct.pack(">2H", tag, len(content)) + content for tag, content in found)
    return HEAD + struct.pack(">I", len(body)) + body


def setup_stream(s: PageSetup) -> bytes:
    """The records of a page setup."""
    layout = bytes([s.rows if s.columns > 1 else 0, int(s.vertical)]) + struct.pack(">H", s.column_gap)
    grid = struct.pack(">BHH", 0x82, s.line_gap, s.half_chars) if s.line_gap is not None else struct.pack(">BH", 0x80, s.half_chars)
    found = [
        (PAPER, struct.pack(">B2I", 6, s.width, s.height)),
        (MARGINS, b"\0" + struct.pack(">B4H", 0x78, *s.margins) + bytes([COLUMNS_BIT | VERTICAL_BIT | GAP_BIT]) + layout),
        (GRID, grid),
        (LINES, struct.pack(">BH", 2, s.lines)),
        (FONT, struct.pack(">BI", 1, s.font)),
        (TWO_UP, b"\0\0\x04" if s.two_up else b"\0\0\0"),
    ]
    for place, (align, distance) in s.headers.items():
        found += [(0x3006 | place << 8, struct.pack(">4BH", 3, 1, 9, 1, distance)), (0x3007 | place << 8, bytes([3, 0x20, align, 0]))]
    return stream(found)

"""Block stores: sub-streams made of numbered blocks, text pieces, token streams and style runs."""

from __future__ import annotations

import struct
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np

from docframe.decode.errors import Corrupt, NotContainer, TooLarge, Unsupported

# Fixed values of the format: stream heads, and words of the unit stream.
STORE, TEXT, PIECES = b"SsmgV.01", b"TextV.01", b"QLSTV.01"
RECORD, RECORD_END, INLINE_START, INLINE_STOP, TAB = 0x1C, 0x1F, 0x1D, 0x1E, 0x09
#: Sub-streams of a store; sizes of blocks that are written.
MOST, BLOCK = 4096, 256


def split_store(data: bytes) -> list[tuple[int, bytes]]:
    """(index, bytes) of each sub-stream. Each block may be used once, and no count is trusted beyond the bytes there."""
    if len(data) < 20 or not data.startswith(STORE):
        raise NotContainer("not a block store")
    n_subs, size, n_blocks = struct.unpack_from(">3I", data, 8)
    if not size or not n_subs or n_subs > MOST:
        raise Corrupt(f"store head with {n_subs} sub-streams of blocks of {size} bytes")
    there = min(n_blocks, (len(data) - 20) // size + 1)
    room = min(there * size, len(data))
    used: set[int] = set()
    at, claimed, out = 20 + size * n_blocks, 0, []
    for _ in range(n_subs):
        if at + 16 > len(data):
            raise Corrupt("the directory is cut off")
        index, _, length, n = struct.unpack_from(">4I", data, at)
        if n > max(0, len(data) - at - 20) // 4:
            raise Corrupt(f"{n} blocks are listed in a shorter stream")
        length = min(length, n * size)
        claimed += length
        if claimed > room:
            raise TooLarge(f"sub-streams claim {claimed} bytes, the blocks hold {room}")
        needed = -(-length // size)
        ids = struct.unpack_from(f">{needed}I", data, at + 20)
        for k in ids:
            if k < there and k in used:
                raise Corrupt(f"block {k} is listed twice")
            used.add(k)
        parts = [data[20 + k * size : 20 + (k + 1) * size] if k < n_blocks else b"" for k in ids]
        out.append((index, b"".join(parts)[:length]))
        at += 20 + 4 * n
    return out


def pack_store(subs: list[bytes]) -> bytes:
    """The store of these sub-streams, in blocks of BLOCK bytes."""
    blocks, rows = [], []
    for index, content in enumerate(subs):
        pieces = [content[k : k + BLOCK].ljust(BLOCK, b"\0") for k in range(0, len(content), BLOCK)]
        ids = range(len(blocks), len(blocks) + len(pieces))
        rows.append(struct.pack(f">5I{len(pieces)}I", index, 0, len(content), len(pieces), len(pieces), *ids))
        blocks += pieces
    return STORE + struct.pack(">3I", len(subs), BLOCK, len(blocks)) + b"".join(blocks) + b"".join(rows) + b"\0" * 4


def text_pieces(data: bytes) -> list[tuple[bytes, bytes]]:
    """(big-endian UTF-16 units, style bytes) of each piece of a text store, in reading order."""
    subs = [d for _, d in split_store(data)]
    head = subs[0]
    if head.startswith(TEXT):
        if len(head) < 12:
            return [(b"", b"")]
        end = min(len(head), 12 + 2 * struct.unpack_from(">I", head, 8)[0])
        return [(head[12 : 12 + (end - 12) // 2 * 2], head[end:])]
    if head.startswith(PIECES):
        count = min(struct.unpack_from(">I", head, 8)[0], max(0, len(head) - 12) // 8) if len(head) >= 12 else 0
        out, seen = [], {0}
        for n, sub in struct.iter_unpack(">2I", head[12 : 12 + 8 * count]):
            if sub >= len(subs):
                raise Corrupt(f"piece of missing sub-stream {sub}")
            if sub in seen:
                raise Corrupt(f"sub-stream {sub} is listed twice")
            seen.add(sub)
            end = min(2 * n, len(subs[sub]))
            out.append((subs[sub][: end // 2 * 2], subs[sub][end:]))
        return out
    raise Unsupported(f"text layout {head[:8]!r}")


def text_store(text: str, style: bytes = b"\xff") -> bytes:
    """A store of one piece."""
    units = text.encode("utf-16-be", "surrogatepass")
    return pack_store([TEXT + struct.pack(">I", len(units) // 2) + units + style])


def lossy(units) -> str:
    """UTF-16 words as text; each unpaired surrogate becomes U+FFFD and takes nothing with it."""
    raw = struct.pack(f">{len(units)}H", *units).decode("utf-16-be", "surrogatepass")
    return "".join("�" if 0xD800 <= ord(c) < 0xE000 else c for c in raw)


@dataclass
class Token:
    kind: str  # text, record, inline or control
    start: int
    code: int = 0  # of a control, or the class of a record
    text: str = ""
    words: tuple[int, ...] = ()  # payload of a record, header of an inline
    text_start: int = 0


class _Units:
    """A unit stream with quick access to its control words and its text."""

    def __init__(self, units):
        words = np.asarray(units, dtype=np.uint16)
        self.raw = words.astype(">u2").tobytes()
        low = (words < 0x20) & (words != TAB) | (words >= 0x7F) & (words <= 0x9F)
        self.unseen = [*np.flatnonzero(low).tolist(), len(words)]
        self.stops = [*np.flatnonzero((words == INLINE_STOP) | (words == RECORD)).tolist(), len(words)]
        self.plain = not ((words >= 0xD800) & (words < 0xE000)).any()

    def next_unseen(self, at: int) -> int:
        return self.unseen[bisect_left(self.unseen, at)]

    def next_stop(self, at: int) -> int:
        return self.stops[bisect_left(self.stops, at)]

    def text(self, start: int, end: int) -> str:
        part = self.raw[2 * start : 2 * end]
        return part.decode("utf-16-be") if self.plain else lossy(struct.unpack(f">{end - start}H", part))


def tokens(units: list[int]) -> list[Token]:
    """Records and inline texts by their frames, runs of text, and what remains as control codes."""
    out, at, n, seen = [], 0, len(units), _Units(units)
    while at < n:
        w = units[at]
        if w == RECORD and at + 2 < n:
            kind, length = units[at + 1], units[at + 2]
            end = at + length
            if kind == 1 and length >= 3 and end <= n and units[end - 1] == INLINE_START:
                stop = seen.next_stop(end)
                out.append(Token("inline", at, 1, seen.text(end, stop), tuple(units[at:end]), end))
                at = stop
                if stop < n and units[stop] == INLINE_STOP:
                    foot = units[stop + 1] if stop + 1 < n else 0
                    whole = foot >= 2 and stop + foot <= n and units[stop + foot - 1] == RECORD_END
                    at = stop + foot if whole else stop + 1
                continue
            if length >= 7 and end <= n and (units[end - 4], units[end - 2], units[end - 1]) == (length, kind, RECORD_END):
                out.append(Token("record", at, kind, words=tuple(units[at + 3 : end - 4])))
                at = end
                continue
        stop = seen.next_unseen(at)
        if stop == at:
            if w != RECORD_END:
                out.append(Token("control", at, w))
            at += 1
            continue
        out.append(Token("text", at, text=seen.text(at, stop)))
        at = stop
    return out


def inline_kind(header) -> str:
    """visible, reading (of the text before) or hidden, by the two selector words."""
    a, b = (*header[4:6], 0, 0)[:2]
    return "reading" if b == 0x82 else "hidden" if (a, b) == (1, 0) else "visible"


def tagged(payload) -> list[tuple[int, tuple[int, ...]]]:
    """(tag, values) of a line record: after one word, tag, count and values until 0xFFFF."""
    out, at = [], 1
    while at + 1 < len(payload) and payload[at] != 0xFFFF:
        n = payload[at + 1]
        out.append((payload[at], tuple(payload[at + 2 : at + 2 + n])))
        at += 2 + n
    return out


def style_events(data: bytes) -> list[tuple[str, object]]:
    """("keep", units) or ("set", [(id, value)]) in order; the list ends at its end mark or where it is damaged."""
    out, at = [], 0
    while at < len(data):
        if data[at] == 0 and at + 5 <= len(data):
            out.append(("keep", struct.unpack_from(">I", data, at + 1)[0]))
            at += 5
        elif data[at] == 0xFE:
            at += 1
            props = []
            while at + 1 < len(data) and data[at] != 0xFF:
                size = data[at + 1]
                value = data[at + 2 : at + 2 + size]
                if len(value) < size:
                    return out
                props.append((data[at], int.from_bytes(value[-4:], "big")))
                at += 2 + size
            if data[at : at + 2] != b"\xff\0":
                break
            at += 2
            out.append(("set", props))
        else:
            break
    return out


def style_spans(data: bytes, n_units: int, budget: int = 2_000_000) -> list[tuple[int, int, dict[int, int]]]:
    """(start, length, properties) that cover n_units; equal neighbours are one span. Copies of state cost `budget`."""
    out: list[list] = []
    state: dict[int, int] = {}
    at = 0

    def cover(n: int) -> None:
        nonlocal at, budget
        n = min(n, n_units - at)
        if n <= 0:
            return
        if out and out[-1][2] == state:
            out[-1][1] += n
        else:
            budget -= max(1, len(state))
            if budget < 0:
                raise TooLarge("the style changes too often")
            out.append([at, n, dict(state)])
        at += n

    for what, value in style_events(data):
        if at >= n_units:
            break
        if what == "set":
            state.update(value)
        cover(value if what == "keep" else 1)
    cover(n_units - at)
    return [tuple(x) for x in out]


def style_bytes(events: list[tuple[str, object]]) -> bytes:
    """The inverse of style_events, values in four bytes."""
    out = b""
    for what, value in events:
        out += b"\0" + struct.pack(">I", value) if what == "keep" else b"\xfe" + b"".join(struct.pack(">BBI", k, 4, v) for k, v in value) + b"\xff\0"
    return out + b"\xff"


def paragraphs(units: list[int]) -> list[tuple[str, bool]]:
    """(text, whether a page break stands before it) of the paragraphs; empty ones at the end are dropped, one stays."""
    out, parts, broken = [], [], False
    for t in tokens(units):
        if t.kind == "text" or t.kind == "inline" and inline_kind(t.words) == "visible":
            parts.append(t.text)
        elif t.kind == "control" and t.code in (0x0A, 0x0D):
            out.append(("".join(parts), broken))
            parts, broken = [], False
        elif t.kind == "control" and t.code == 0x0C:
            if parts:
                out.append(("".join(parts), broken))
                parts = []
            broken = True
    out.append(("".join(parts), broken))
    while len(out) > 1 and not out[-1][0]:
        out.pop()
    return out

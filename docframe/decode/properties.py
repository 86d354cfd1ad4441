"""Property sets, font tables, file times."""

from __future__ import annotations

import struct
from datetime import UTC, datetime, timedelta

# Fixed values of the format: property numbers and code pages.
NAMES = {2: "title", 3: "subject", 4: "author", 5: "keywords", 6: "comments", 7: "template", 8: "last_author", 9: "revision", 11: "printed", 12: "created", 13: "saved", 14: "pages", 16: "chars", 18: "application"}
PAGES = {932: "cp932", 65001: "utf-8", 1252: "cp1252", 949: "cp949"}
FONTS = b"FontV.01"


def file_time(ticks: int) -> str | None:
    """`YYYY-MM-DD HH:MM` (UTC) of a count of 100 ns since 1601; None up to 1970."""
    seconds = ticks // 10_000_000 - 11_644_473_600
    if seconds <= 0:
        return None
    try:
        return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=seconds)).strftime("%Y-%m-%d %H:%M")
    except OverflowError:
        return None


def summary(data: bytes) -> dict[str, object]:
    """The known properties of the first section of a property set; unreadable ones are left out."""

    def number(form, at):
        return struct.unpack_from(form, data, at)[0] if 0 <= at and at + struct.calcsize(form) <= len(data) else None

    section = number("<I", 44)
    count = number("<I", section + 4) if section is not None else None
    found = []
    for k in range(min(count or 0, 256)):
        pid, at = number("<I", section + 8 + 8 * k), number("<I", section + 12 + 8 * k)
        if pid is None or at is None:
            break
        found.append((pid, section + at))
    page = next((number("<H", at + 4) for pid, at in found if pid == 1), None) or 932
    out: dict[str, object] = {}
    for pid, at in found:
        kind, name = (number("<I", at) or 0) & 0xFFFF, NAMES.get(pid)
        if name is None:
            continue
        value: object = None
        if kind in (2, 3):
            value = number("<h" if kind == 2 else "<i", at + 4)
        elif kind in (30, 31):
            size = (number("<I", at + 4) or 0) * (kind - 29)
            raw = data[at + 8 : at + 8 + size]
            if len(raw) == size:
                text = raw.split(b"\0")[0].decode(PAGES.get(page, "cp932"), "replace") if kind == 30 else raw.decode("utf-16-le", "replace").rstrip("\0")
                value = text.strip() or None
        elif kind == 64:
            value = file_time(number("<Q", at + 4) or 0)
        if value is not None and (pid in (14, 16)) == isinstance(value, int):
            out[name] = value
    return out


def fonts(data: bytes) -> list[tuple[str, int]]:
    """(name, character set) of a font table, 256 at most."""
    if len(data) < 10 or not data.startswith(FONTS):
        return []

    def word_text(at: int) -> tuple[str, int]:
        end = at
        while end + 1 < len(data) and data[end : end + 2] != b"\0\0":
            end += 2
        return data[at:end].decode("utf-16-be", "replace"), end + 2

    out, at = [], 10
    for _ in range(min(struct.unpack_from(">H", data, 8)[0], 256)):
        if at + 30 > len(data):
            break
        charset = data[at + 25]
        name, at = word_text(at + 30)
        _, at = word_text(at + 12)
        out.append((name, charset))
    return out


def summary_bytes(values: dict[int, str | int]) -> bytes:
    """A property set with one section: texts as UTF-16, numbers as 32 bits; times are numbers of 64 bits above that."""
    rows, body = b"", b""
    start = 8 + 8 * len(values)
    for pid, value in values.items():
        rows += struct.pack("<2I", pid, start + len(body))
        if isinstance(value, str):
            raw = (value + "\0").encode("utf-16-le")
            body += struct.pack("<2I", 31, len(raw) // 2) + raw.ljust(-(-len(raw) // 4) * 4, b"\0")
        else:
            body += struct.pack("<Ii", 3, value) if value < 1 << 31 else struct.pack("<IQ", 64, value)
    return b"\xfe\xff\0\0".ljust(28, b"\0") + b"\0" * 16 + struct.pack("<I", 48) + struct.pack("<2I", start + len(body), len(values)) + rows + body


def fonts_bytes(names: list[tuple[str, int]]) -> bytes:
    """The font table of (name, character set)."""
    one = lambda name, charset: b"\0" * 25 + bytes([charset]) + b"\0" * 4 + name.encode("utf-16-be") + b"\0\0" + b"\0" * 12 + b"\0\0"
    return FONTS.ljust(8, b"\0") + struct.pack(">H", len(names)) + b"".join(one(*x) for x in names)


def sheet_names(data: bytes) -> list[str]:
    """Texts of little-endian words that can be names of sheets: shorter than 64 characters, no path and no storage name."""
    return [t for t in _word_texts(data) if len(t) < 64 and not t.startswith("DOCS_") and "\\" not in t and ":" not in t]


def _word_texts(data: bytes) -> list[str]:
    words = struct.unpack(f"<{len(data) // 2}H", data[: len(data) // 2 * 2])
    raw = "".join(chr(w) if w >= 0x20 and w != 0xFFFF else "\n" for w in words)
    return [t.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") for t in raw.split("\n") if t]

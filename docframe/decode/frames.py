"""Frames of a page, the objects that they show, pictures inside of objects, page backgrounds."""

from __future__ import annotations

import struct

# Fixed values of the format: the record of a frame and where its fields stand, marks of picture files, records of a
# background, and limits on lists.
FRAME, FRAME_BYTES, MOST = 0x0102, 42, 4096
AROUND, UNDER, EMPTY_TOO = 0x380, 0x004, 0x080
MARKS = ((b"GIF8", "image/gif"), (b"\x89PNG", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"BM", "image/bmp"))
ENTRY, NAME_SIZE, AFTER_NAME, ENTRY_BYTES = 8, 0x2A, 0x2E, 0x7E
KIND, FILE, COLOUR, LAST, NO_PATH = 0x0C, 0x0D, 0x10, 0xFFFE, 0xFFFF
ANCHOR = (0x30, 0x507)


def frames(data: bytes) -> list[dict]:
    """Frames in stacking order: id, kind (1 picture, 2 text box, 4 figure), item, place and size, and how text goes round."""
    out, at = [], 8
    while at + 4 <= len(data) and len(out) < MOST:
        tag, size = struct.unpack_from(">2H", data, at)
        if not size:
            break
        record = data[at + 4 : at + 4 + size]
        at += 4 + size
        if tag != FRAME or len(record) < FRAME_BYTES - 4:
            continue
        words = struct.unpack_from(f">{len(record) // 2}H", record)
        x, y, w, h = struct.unpack_from(">2i2I", record, 22)
        flags = words[25] if len(words) > 25 else 0
        out.append({"id": words[1], "kind": words[2], "item": words[4], "x": x, "y": y, "w": w, "h": h, "on_text": words[5] == 1, "fixed": words[6] == 2, "wrap": flags & AROUND != 0 and not flags & UNDER, "wrap_blank": flags & (AROUND | UNDER) == EMPTY_TOO})
    return out


def frames_bytes(rows: list[dict]) -> bytes:
    """The stream of these frames."""
    out = b"\0" * 8
    for r in rows:
        flags = EMPTY_TOO if r.get("wrap_blank") else 0x300 if r.get("wrap") else 0
        words = [0, r["id"], r["kind"], 0, r["item"], int(r.get("on_text", False)), 2 if r.get("fixed") else 1, 0, 0, 0, 0]
        body = struct.pack(">11H2i2I", *words, r["x"], r["y"], r["w"], r["h"]) + b"\0" * 12 + struct.pack(">H", flags)
        out += struct.pack(">2H", FRAME, len(body)) + body
    return out + b"\0" * 4


def embeddings(data: bytes) -> list[tuple[int, int]]:
    """(frame id, number of the storage that it shows), in the order of the entries."""
    out, at = [], 16
    count = struct.unpack_from("<I", data)[0] if len(data) >= 4 else 0
    for _ in range(min(count, MOST)):
        if at + AFTER_NAME > len(data):
            break
        number, size = struct.unpack_from("<I", data, at + ENTRY)[0], struct.unpack_from("<I", data, at + NAME_SIZE)[0]
        if size > 512 or at + AFTER_NAME + size + 4 > len(data):
            break
        out.append((struct.unpack_from("<I", data, at + AFTER_NAME + size)[0] & 0xFFFF, number & 0xFFFF))
        at += ENTRY_BYTES + size
    return out


def embeddings_bytes(rows: list[tuple[int, int]], name: str = "JS.PictureCtrl.1") -> bytes:
    raw = name.encode("utf-16-le")
    one = lambda frame, number: b"\0" * 8 + struct.pack("<I", number) + b"\0" * 30 + struct.pack("<I", len(raw)) + raw + struct.pack("<I", frame) + b"\0" * 0x4C
    return struct.pack("<I", len(rows)) + b"\0" * 12 + b"".join(one(*r) for r in rows)


def picture(contents: bytes) -> tuple[str, bytes] | None:
    """(type, file) of the picture inside an object: after a head of unknown size, its length right before it."""
    head = contents[:2052]
    places = sorted((at, kind) for mark, kind in MARKS for at in _all(head, mark) if 4 <= at < 2048)
    for at, kind in places:
        size = struct.unpack_from("<I", contents, at - 4)[0]
        if 16 < size <= len(contents) - at:
            return kind, contents[at : at + size]
        if kind != "image/bmp":
            return kind, contents[at:]
    return None


def _all(data: bytes, mark: bytes):
    at = data.find(mark)
    while at >= 0:
        yield at
        at = data.find(mark, at + 1)


def background(data: bytes) -> dict:
    """The page's background: {"color"}, {"mime", "data"}, or nothing."""
    at, found = 8, {}
    if len(data) < at + 2:
        return {}
    if data[at : at + 2] != b"\xff\xff":  # a path comes first
        size = struct.unpack_from(">I", data, at + 2)[0] if len(data) >= at + 6 else 0
        at += 6 + 2 * min(size, MOST)
    if data[at : at + 2] == b"\xff\xff":
        at += 6
    for _ in range(64):
        if at + 6 > len(data):
            break
        tag, size = struct.unpack_from(">HI", data, at)
        body = data[at + 6 : at + 6 + size]
        if tag == LAST or len(body) < size:
            break
        found[tag] = body
        at += 6 + size
    kind = int.from_bytes(found.get(KIND, b"")[:4], "big") if len(found.get(KIND, b"")) >= 4 else 0
    if kind == 1 and len(found.get(COLOUR, b"")) >= 4:
        b, g, r = found[COLOUR][1:4]
        return {"color": f"#{r:02x}{g:02x}{b:02x}"}
    mime = next((m for mark, m in MARKS if found.get(FILE, b"").startswith(mark)), None)
    return {"mime": mime, "data": found[FILE]} if kind == 3 and mime else {}


def background_bytes(color: tuple[int, int, int] | None = None, file: bytes | None = None, path: str = "") -> bytes:
    record = lambda tag, body: struct.pack(">HI", tag, len(body)) + body
    named = struct.pack(">HI", 1, len(path)) + path.encode("utf-16-be") if path else b""
    body = record(KIND, struct.pack(">I", 1 if color else 3))
    body += record(COLOUR, bytes([0, *reversed(color)])) if color else record(FILE, file or b"")
    return b"\0" * 8 + named + struct.pack(">HI", NO_PATH, 0) + body + struct.pack(">HI", LAST, 0)


def anchor(payload) -> int | None:
    """The frame id of a context record that anchors a frame in a text."""
    return payload[5] if len(payload) >= 6 and (payload[1], payload[3]) == ANCHOR else None

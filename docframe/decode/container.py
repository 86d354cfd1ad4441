"""Compound files (structured storage): reading as a table of entries, and writing."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from docframe.decode.errors import Corrupt, NotContainer

# Fixed values of the format: the signature, chain marks, entry kinds.
SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
FREE, END, FAT_MARK = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD
SPECIAL = 0xFFFFFFFA
KINDS = {1: "storage", 2: "stream", 5: "root"}
DEPTH = 64


@dataclass
class Entry:
    path: str
    name: str
    kind: str
    size: int
    start: int
    state: int = 0
    created: int = 0
    modified: int = 0


@dataclass
class Container:
    entries: list[Entry]
    warnings: list[str]
    _regular: object = field(repr=False, default=None)
    _small: object = field(repr=False, default=None)
    _cutoff: int = 4096

    def read(self, entry: Entry) -> bytes:
        follow = self._small if entry.size < self._cutoff else self._regular
        return follow(entry.start, entry.size)

    def find(self, path: str) -> Entry | None:
        return next((e for e in self.entries if e.path == path), None)


def is_container(data: bytes) -> bool:
    return len(data) >= 512 and data.startswith(SIGNATURE)


def _chain(table: np.ndarray, start: int, most: int | None) -> list[int]:
    """Sector numbers from start on; a loop or a number outside the table ends the chain."""
    out, seen = [], set()
    while start < SPECIAL and start not in seen and (most is None or len(out) < most):
        seen.add(start)
        out.append(start)
        start = int(table[start]) if start < len(table) else END
    return out


def open_container(data: bytes) -> Container:
    """Lenient on loops and numbers out of range, which become warnings or end a chain."""
    if not is_container(data):
        raise NotContainer("no compound-file signature")
    major, _, big, small = struct.unpack_from("<4H", data, 26)
    if big not in (9, 12) or small > 12:
        raise Corrupt(f"sector sizes 2**{big} and 2**{small}")
    n_fat, first_dir, _, cutoff, first_mini, _, first_more, n_more = struct.unpack_from("<8I", data, 44)
    size, warnings = 1 << big, []

    def sector(n: int) -> bytes:
        return data[(n + 1) * size : (n + 2) * size]

    listed = [x for x in struct.unpack_from("<109I", data, 76) if x < SPECIAL]
    seen: set[int] = set()
    for _ in range(n_more):
        if first_more >= SPECIAL or first_more in seen:
            break
        seen.add(first_more)
        block = sector(first_more)
        if len(block) < size:
            warnings.append(f"sector {first_more} of the sector list is missing")
            break
        *more, first_more = struct.unpack(f"<{size // 4}I", block)
        listed += [x for x in more if x < SPECIAL]
    if n_fat:
        listed = listed[:n_fat]
    parts = []
    for n in listed:
        block = sector(n)
        if not block:
            warnings.append(f"table sector {n} is missing")
        parts.append(np.frombuffer(block[: len(block) // 4 * 4], "<u4"))
    table = np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def regular(start: int, length: int | None = None) -> bytes:
        most = None if length is None else -(-length // size)
        out = b"".join(sector(n) for n in _chain(table, start, most))
        return out if length is None else out[:length]

    rows = regular(first_dir)
    records = [rows[k : k + 128] for k in range(0, len(rows) // 128 * 128, 128)]
    if not records or records[0][66] != 5:
        raise Corrupt("no root entry")
    fields = [_record(r, major) for r in records]
    _, _, _, root = fields[0]
    mini_table = np.frombuffer(regular(first_mini), "<u4")
    mini_data = regular(root.start, root.size)
    unit = 1 << small

    def tiny(start: int, length: int) -> bytes:
        return b"".join(mini_data[n * unit : (n + 1) * unit] for n in _chain(mini_table, start, -(-length // unit)))[:length]

    root.path = "/"
    return Container([root, *_walk(fields, warnings)], warnings, regular, tiny, cutoff)


def _record(r: bytes, major: int) -> tuple[int, int, int, Entry]:
    length = max(0, min(64, struct.unpack_from("<H", r, 64)[0]) - 2)
    name = r[:length].decode("utf-16-le", "replace")
    left, right, child = struct.unpack_from("<3I", r, 68)
    state, created, modified, start, size = struct.unpack_from("<IQQIQ", r, 96)
    return left, right, child, Entry("", name, KINDS.get(r[66], ""), size & 0xFFFFFFFF if major == 3 else size, start, state, created, modified)


def _walk(fields, warnings: list[str]) -> list[Entry]:
    """Entries in tree order, without recursion: an explicit stack of visits and outputs."""
    out, seen = [], {0}
    stack = [("visit", fields[0][2], "", 0)]
    while stack:
        what, k, parent, depth = stack.pop()
        if what == "put":
            entry = fields[k][3]
            if entry.kind in ("storage", "stream"):
                entry.path = f"{parent}/{entry.name}"
                out.append(entry)
                if entry.kind == "storage":
                    stack.append(("visit", fields[k][2], entry.path, depth + 1))
            continue
        if k == FREE or depth > DEPTH:
            continue
        if k >= len(fields):
            warnings.append(f"entry {k} is missing")
        elif k in seen:
            warnings.append(f"entry {k} is met twice")
        else:
            seen.add(k)
            left, right, _, _ = fields[k]
            stack += [("visit", right, parent, depth + 1), ("put", k, parent, depth), ("visit", left, parent, depth + 1)]
    return out


def _order(name: str) -> tuple[int, str]:
    """Siblings are ordered by length, then by code units with a to z as capitals."""
    return len(name.encode("utf-16-le")), "".join(c.upper() if "a" <= c <= "z" else c for c in name)


def write_container(streams: dict[str, bytes]) -> bytes:
    """A compound file (512-byte sectors) with these streams; storages follow from the paths."""
    nodes = [{"name": "Root Entry", "kind": 5, "kids": {}, "data": b""}]
    for path, content in streams.items():
        at = nodes[0]
        *folders, last = path.strip("/").split("/")
        for name in folders:
            if name not in at["kids"]:
                nodes.append({"name": name, "kind": 1, "kids": {}, "data": b""})
                at["kids"][name] = nodes[-1]
            at = at["kids"][name]
        nodes.append({"name": last, "kind": 2, "kids": {}, "data": content})
        at["kids"][last] = nodes[-1]
    number = {id(n): k for k, n in enumerate(nodes)}
    sectors: list[bytes] = []
    table: list[int] = []

    def put(content: bytes) -> int:
        pieces = [content[k : k + 512].ljust(512, b"\0") for k in range(0, len(content), 512)]
        first = len(sectors)
        sectors.extend(pieces)
        table.extend([*range(first + 1, first + len(pieces)), END] if pieces else [])
        return first if pieces else END

    mini, mini_table = b"", []
    for n in nodes:
        n["start"], n["size"] = END, len(n["data"])
        if n["kind"] == 2 and 0 < n["size"] < 4096:
            units = -(-n["size"] // 64)
            n["start"] = len(mini_table)
            mini_table += [*range(n["start"] + 1, n["start"] + units), END]
            mini += n["data"].ljust(units * 64, b"\0")
        elif n["kind"] == 2 and n["size"]:
            n["start"] = put(n["data"])
    nodes[0]["start"], nodes[0]["size"] = put(mini), len(mini)
    first_mini = put(struct.pack(f"<{len(mini_table)}I", *mini_table).ljust(-(-len(mini_table) * 4 // 512) * 512, b"\xff")) if mini_table else END
    mini_sectors = -(-len(mini_table) * 4 // 512)

    links = {id(n): [FREE, FREE, FREE, 1] for n in nodes}

    def tree(kids: list[dict], low: int, high: int, depth: int, full: int) -> int:
        if low >= high:
            return FREE
        mid = (low + high) // 2
        own = links[id(kids[mid])]
        own[0], own[1] = tree(kids, low, mid, depth + 1, full), tree(kids, mid + 1, high, depth + 1, full)
        own[3] = 0 if depth == full and depth > 0 else 1  # the lowest, incomplete level is red
        return number[id(kids[mid])]

    for n in nodes:
        kids = sorted(n["kids"].values(), key=lambda x: _order(x["name"]))
        links[id(n)][2] = tree(kids, 0, len(kids), 0, max(0, len(kids).bit_length() - 1))
    rows = b""
    for n in nodes:
        name = n["name"].encode("utf-16-le")[:62]
        left, right, child, colour = links[id(n)]
        rows += name.ljust(64, b"\0") + struct.pack("<HBB3I16sIQQIQ", len(name) + 2, n["kind"], colour, left, right, child, b"", 0, 0, 0, n["start"], n["size"])
    blank = b"\0" * 64 + struct.pack("<HBB3I", 0, 0, 0, FREE, FREE, FREE) + b"\0" * 48
    while len(rows) % 512:
        rows += blank
    first_dir = put(rows)

    # The table lists its own sectors and those of the sector list, too.
    n_fat = n_more = 0
    while True:
        need = -(-(len(table) + n_fat + n_more) // 128)
        more = max(0, -(-(need - 109) // 127))
        if (need, more) == (n_fat, n_more):
            break
        n_fat, n_more = need, more
    own = [*range(len(sectors), len(sectors) + n_fat)]
    lists = [*range(len(sectors) + n_fat, len(sectors) + n_fat + n_more)]
    table += [FAT_MARK] * n_fat + [0xFFFFFFFC] * n_more
    packed = struct.pack(f"<{len(table)}I", *table).ljust(n_fat * 512, b"\xff")
    sectors += [packed[k : k + 512] for k in range(0, len(packed), 512)]
    rest = own[109:]
    for k, at in enumerate(lists):
        part = rest[k * 127 : (k + 1) * 127]
        sectors.append(struct.pack("<128I", *part, *[FREE] * (127 - len(part)), lists[k + 1] if k + 1 < len(lists) else END))
        assert at == len(sectors) - 1
    head = SIGNATURE + b"\0" * 16 + struct.pack("<5H6x9I", 0x3E, 3, 0xFFFE, 9, 6, 0, n_fat, first_dir, 0, 4096, first_mini, mini_sectors, lists[0] if lists else END, n_more)
    first = own[:109]
    return head + struct.pack("<109I", *first, *[FREE] * (109 - len(first))) + b"".join(sectors)


def streams_of(c: Container) -> dict[str, bytes]:
    """The content of each stream by its path."""
    return {e.path: c.read(e) for e in c.entries if e.kind == "stream"}


def edited(data: bytes, replaced: dict[str, bytes], removed: frozenset[str] | set[str] = frozenset()) -> bytes:
    """The file with streams replaced or added, and streams or whole storages removed."""
    kept = streams_of(open_container(data)) | replaced
    return write_container({p: content for p, content in kept.items() if not any(p == r or p.startswith(f"{r}/") for r in removed)})


def is_embedded(name: str) -> bool:
    """Whether a storage of this name holds an embedded object."""
    return (low := name.lower()).startswith(("embedding", "oleitem")) or low == "figuredata"

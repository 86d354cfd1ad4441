"""Members of LHA archives (methods lh0, lh4 to lh7), as compressed documents carry them."""

from __future__ import annotations

import struct

from docframe.decode.errors import Corrupt, TooLarge

# Fixed values of the format: window bits by method; sizes of the three code alphabets.
WINDOW = {"lh4": 12, "lh5": 13, "lh6": 15, "lh7": 16}
LITERALS, LENGTHS = 510, 19


class _Bits:
    """Bits from the most significant on; a few zero bytes follow the data."""

    def __init__(self, data: bytes):
        self.value = int.from_bytes(data + b"\0" * 8, "big")
        self.left = 8 * (len(data) + 8)

    def look(self, n: int) -> int:
        return (self.value >> max(0, self.left - n)) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        if n > self.left:
            raise Corrupt("the packed data end early")
        out = self.look(n)
        self.left -= n
        return out


class _Chunked(_Bits):
    """The same over a long string, of which 4 kB at a time are held as a number."""

    def __init__(self, data: bytes):
        self.data, self.at = data + b"\0" * 8, 0
        super().__init__(b"")
        self.value, self.left = 0, 0

    def _fill(self, n: int) -> None:
        while self.left < n and self.at < len(self.data):
            more = self.data[self.at : self.at + 4096]
            self.value = ((self.value & ((1 << self.left) - 1)) << (8 * len(more))) | int.from_bytes(more, "big")
            self.left += 8 * len(more)
            self.at += len(more)

    def look(self, n: int) -> int:
        self._fill(n)
        return (self.value >> (self.left - n)) & ((1 << n) - 1) if n <= self.left else (self.value & ((1 << self.left) - 1)) << (n - self.left)

    def take(self, n: int) -> int:
        self._fill(n)
        return super().take(n)


class _Code:
    """A canonical prefix code as a dictionary from (length, bits) to symbol."""

    def __init__(self, lengths: list[int], only: int | None = None):
        self.only, self.symbols, code = only, {}, 0
        if only is None:
            if sum(2.0**-n for n in lengths if n) > 1 or max(lengths, default=0) > 16:
                raise Corrupt("bad code lengths")
            for n in range(1, 17):
                for symbol, own in enumerate(lengths):
                    if own == n:
                        self.symbols[n, code] = symbol
                        code += 1
                code <<= 1

    def read(self, bits: _Bits) -> int:
        if self.only is not None:
            return self.only
        code = 0
        for n in range(1, 17):
            code = code << 1 | bits.take(1)
            if (symbol := self.symbols.get((n, code))) is not None:
                return symbol
        raise Corrupt("bad code")


def _small_code(bits: _Bits, most: int, width: int, gap: int | None) -> _Code:
    n = bits.take(width)
    if n == 0:
        return _Code([], bits.take(width))
    lengths: list[int] = []
    while len(lengths) < n:
        size = bits.take(3)
        if size == 7:
            while bits.take(1):
                size += 1
        lengths.append(size)
        if len(lengths) == gap:
            lengths += [0] * bits.take(2)
    if len(lengths) > most:
        raise Corrupt("bad code table")
    return _Code(lengths)


def _literal_code(bits: _Bits, small: _Code) -> _Code:
    n = bits.take(9)
    if n == 0:
        return _Code([], bits.take(9))
    lengths: list[int] = []
    while len(lengths) < n:
        kind = small.read(bits)
        lengths += [kind - 2] if kind > 2 else [0] * (1 if kind == 0 else 3 + bits.take(4) if kind == 1 else 20 + bits.take(9))
    if n > LITERALS:
        raise Corrupt("bad code table")
    return _Code(lengths[:LITERALS])


def unpacked(data: bytes, size: int, method: str) -> bytes:
    """`size` bytes from the packed data of a member."""
    if method == "lh0":
        return data[:size]
    window = WINDOW[method]
    bits, out, block = _Chunked(data), bytearray(), 0
    while len(out) < size:
        if not block:
            block = bits.take(16)
            if not block:
                raise Corrupt("an empty block")
            literals = _literal_code(bits, _small_code(bits, LENGTHS, 5, 3))
            places = _small_code(bits, window + 1, 4 if window <= 13 else 5, None)
        block -= 1
        symbol = literals.read(bits)
        if symbol < 256:
            out.append(symbol)
            continue
        near = places.read(bits)
        back = 1 + (0 if near == 0 else (1 << near - 1) + bits.take(near - 1))
        if back > len(out):
            raise Corrupt("a copy from before the start")
        for _ in range(min(symbol - 253, size - len(out))):
            out.append(out[-back])
    return bytes(out)


def first_member(data: bytes, most: int) -> bytes | None:
    """The content of the first member, whose head (of level 0 to 3) may stand anywhere; None without one."""
    at = -1
    while (at := data.find(b"-lh", at + 1)) >= 0:
        head = at - 2
        if head < 0 or data[at + 4 : at + 5] != b"-" or head + 21 > len(data):
            continue
        method, level = data[at + 1 : at + 4].decode("latin-1"), data[head + 20]
        if level > 3 or method not in ("lh0", *WINDOW):
            continue
        packed, size = struct.unpack_from("<2I", data, head + 7)
        start = head + (data[head] + 2 if level < 2 else struct.unpack_from("<H", data, head)[0])
        if level == 1:  # chained heads, counted in the packed size
            more = struct.unpack_from("<H", data, start - 2)[0] if start <= len(data) else 0
            while more and start + more <= len(data):
                packed, start = packed - more, start + more
                more = struct.unpack_from("<H", data, start - 2)[0]
        elif level == 3:
            start = head + struct.unpack_from("<I", data, head + 24)[0]
        if size > most:
            raise TooLarge(f"a member of {size} bytes")
        return unpacked(data[start : start + max(packed, 0)], size, method)
    return None


def stored_member(name: str, content: bytes) -> bytes:
    """An archive of one member that isn't packed, with a head of level 0."""
    raw = name.encode("latin-1")
    body = b"-lh0-" + struct.pack("<2I", len(content), len(content)) + b"\0" * 4 + b"\x20\0" + bytes([len(raw)]) + raw + b"\0\0"
    return bytes([len(body), sum(body) % 256]) + body + content + b"\0"

"""Decoders: round trips, hostile inputs, files as tables."""

import struct
import time

import pytest

from docframe.decode import archive, blocks, container, kinds, properties
from docframe.decode.errors import Corrupt, DecodeError, NotContainer, TooLarge
from docframe.functions.lines import break_lines
from docframe.limits import Limits
from docframe.sources import files


def words(*parts):
    return [w for p in parts for w in (map(ord, p) if isinstance(p, str) else p)]


INLINE = [0x1C, 1, 7, 0, 0, 3, 0x1D]
FOOT = [0x1E, 5, 0, 1, 0x1F]


@pytest.mark.parametrize("sizes", [(0, 1, 63, 64, 4095, 4096, 5000), (70_000,), (8_000_000,)])
def test_container_round_trip(sizes):
    streams = {f"/Store {k % 2}/s{k}": bytes(i * 7 % 251 for i in range(min(n, 1000))) * (n // 1000 or 1) for k, n in enumerate(sizes)}
    c = container.open_container(container.write_container(streams))
    assert not c.warnings
    assert {e.path: c.read(e) for e in c.entries if e.kind == "stream"} == streams


def test_container_damage():
    data = bytearray(container.write_container({"/a": b"x" * 9000}))
    with pytest.raises(NotContainer):
        container.open_container(b"no")
    for cut in range(512, len(data), 700):
        try:
            c = container.open_container(bytes(data[:cut]))
            [c.read(e) for e in c.entries]
        except (DecodeError, struct.error):
            pass
    loop = data.copy()
    loop[512:1024] = b"\0" * 512  # whatever stood there
    try:
        container.open_container(bytes(loop))
    except (DecodeError, struct.error):
        pass


def test_store_and_pieces():
    text = "Ein Satz.\nZweite Zeile \U0001f600\n"
    (units, style), = blocks.text_pieces(blocks.text_store(text))
    assert units.decode("utf-16-be") == text and style == b"\xff"
    two = blocks.pack_store([blocks.PIECES + struct.pack(">I", 2) + struct.pack(">4I", 2, 2, 1, 1), "c".encode("utf-16-be"), "ab".encode("utf-16-be")])
    assert [u.decode("utf-16-be") for u, _ in blocks.text_pieces(two)] == ["ab", "c"]


def test_hostile_stores():
    began = time.time()
    head = blocks.STORE + struct.pack(">3I", 1, 256, 1) + b"\0" * 256
    with pytest.raises(TooLarge):
        blocks.split_store(head + struct.pack(">5I", 0, 0, 11_000 * 256, 11_000, 11_000) + struct.pack(">I", 0) * 11_000)
    with pytest.raises(Corrupt):
        blocks.split_store(blocks.STORE + struct.pack(">3I", 1, 256, 2) + b"\0" * 512 + struct.pack(">7I", 0, 0, 512, 2, 2, 1, 1))
    with pytest.raises(Corrupt):
        blocks.split_store(head + struct.pack(">5I", 0, 0, 256, 99, 99))
    blocks.split_store(head + struct.pack(">5I", 0, 0, 0xFFFFFFFF, 0, 0))
    twice = blocks.pack_store([blocks.PIECES + struct.pack(">5I", 2, 1, 1, 1, 1), b"\0a"])
    with pytest.raises(Corrupt):
        blocks.text_pieces(twice)
    assert time.time() - began < 2


def test_tokens():
    got = blocks.tokens(words("ab\tc", [0x0A], [0x1C, 0x30, 9, 0, 5, 9, 0, 0x30, 0x1F], INLINE, "base", FOOT, "z"))
    assert [(t.kind, t.text or t.code) for t in got] == [("text", "ab\tc"), ("control", 0x0A), ("record", 0x30), ("inline", "base"), ("text", "z")]
    assert blocks.inline_kind([0x1C, 1, 7, 0, 1, 0x82]) == "reading" and blocks.inline_kind([0x1C, 1, 7, 0, 1, 0]) == "hidden"
    assert blocks.lossy([0xD800, 0x41]) == "�A"
    assert blocks.tagged([0, 0x24, 1, 2, 0x26, 2, 7, 8, 0xFFFF, 0]) == [(0x24, (2,)), (0x26, (7, 8))]


def test_paragraphs():
    assert blocks.paragraphs(words("a", [0x0A], "b", [0x0C], "c", [0x0A, 0x0A, 0x0A])) == [("a", False), ("b", False), ("c", True)]
    assert blocks.paragraphs([]) == [("", False)]


def test_style_spans():
    data = blocks.style_bytes([("keep", 2), ("set", [(20, 1)]), ("keep", 3), ("set", [(20, 1)]), ("set", [(3, 7)]), ("keep", 99)])
    assert blocks.style_spans(data, 12) == [(0, 2, {}), (2, 5, {20: 1}), (7, 5, {20: 1, 3: 7})]
    assert sum(n for _, n, _ in blocks.style_spans(data, 12)) == 12
    with pytest.raises(TooLarge):
        blocks.style_spans(blocks.style_bytes([("set", [(k % 256, k)]) for k in range(5000)]), 9999, budget=10_000)


def _packed(text: bytes) -> bytes:
    """Literals only, with a code of 8 bits for each byte: what a simple packer would write."""
    # Eleven lengths of the small code: three zeros, a gap of three more, and one bit for the last symbol (length 8).
    bits = f"{len(text):016b}{11:05b}" + "000" * 3 + "11" + "000" * 4 + "001"
    bits += f"{256:09b}" + "0" * 256 + f"{0:04b}{0:04b}" + "".join(f"{b:08b}" for b in text)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_archive():
    text = b"hello hello hello, archive"
    body = _packed(text)
    assert archive.unpacked(body, len(text), "lh5") == text
    head = bytes([22, 0]) + b"-lh5-" + struct.pack("<2I", len(body), len(text)) + b"\0\0\0\0\x20\0" + b"\0" + b"\0\0"
    assert archive.first_member(b"??" + head[:22].ljust(24, b"\0") + body, 1000) == text
    with pytest.raises(TooLarge):
        archive.first_member(b"??" + head[:22].ljust(24, b"\0") + body, 3)
    with pytest.raises(DecodeError):
        archive.unpacked(b"\xff" * 40, 1000, "lh5")
    assert archive.first_member(b"nothing", 10) is None


def test_properties():
    assert properties.file_time(0) is None
    assert properties.file_time((11_644_473_600 + 86_400) * 10_000_000) == "1970-01-02 00:00"
    values = {1: struct.pack("<IH2x", 2, 65001), 2: struct.pack("<II", 30, 6) + "Été".encode() + b"\0", 14: struct.pack("<Ii", 3, 7), 12: struct.pack("<IQ", 64, (11_644_473_600 + 60) * 10_000_000)}
    table, body = b"", b""
    for pid, v in values.items():
        table += struct.pack("<2I", pid, 8 + 8 * len(values) + len(body))
        body += v
    data = b"\0" * 44 + struct.pack("<I", 48) + struct.pack("<2I", 0, len(values)) + table + body
    assert properties.summary(data) == {"title": "Été", "pages": 7, "created": "1970-01-01 00:01"}
    assert properties.summary(b"") == {}
    font = properties.FONTS + struct.pack(">H", 1) + b"\0" * 25 + b"\x80" + b"\0" * 4 + "Mincho".encode("utf-16-be") + b"\0\0" + b"\0" * 12 + b"\0\0"
    assert [n for n, _ in properties.fonts(font)] == ["Mincho"]


@pytest.mark.parametrize(("data", "kind"), [(b"", "empty"), (b"{\\rtf1", "rtf"), (b"%PDF-1", "pdf"), (b"PK\3\4", "zip"), (b"..-lh5-..", "lzh"), (b"\x89PNG", "image"), (b"  <HTML>", "html"), (b"plain\r\n", "text"), (b"\1\2", "unknown")])
def test_kinds(data, kind):
    assert kinds.file_kind(data) == kind


def test_limits():
    assert Limits.from_json('{"maxBytes": 5, "maxSheets": 0, "maxPages": "x"}') == Limits(max_bytes=5)
    assert Limits.from_json("nonsense") == Limits()


def test_files_as_tables(spark, tmp_path):
    good = container.write_container({"/DocumentText": blocks.text_store("one\ntwo")})
    (tmp_path / "good.jtd").write_bytes(good)
    (tmp_path / "bad.jtd").write_bytes(b"{\\rtf not a container")
    found = files.scan(spark, str(tmp_path), "*.jtd")
    rows = files.paragraphs(found).collect()
    assert sorted(r["text"] for r in rows if r["text"]) == ["one", "two"]
    assert [r["error_class"] for r in rows if r["error_class"]] == ["NotContainer"]
    assert {r["kind"] for r in files.file_kinds(found).collect()} == {"jtd", "rtf"}
    small = files.paragraphs(found, Limits(max_text_units=2)).where("error_class = 'TooLarge'")
    assert small.count() == 1
    assert files.summaries(found).count() == 2


def test_break_lines():
    assert break_lines("abcdef", 3) == [(0, 3), (3, 6)]
    assert break_lines("abc,d", 3) == [(0, 4), (4, 5)]
    assert break_lines("漢字（漢字", 6) == [(0, 2), (2, 5)]
    assert break_lines("", 5) == [(0, 0)]

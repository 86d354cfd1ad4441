"""Saving: styles follow their characters, refusals, verification; PDF and page flow."""

import re
import zlib

import pytest

from docframe.decode import blocks as B, blocktree as T, pdf, save
from docframe.functions.flow import placed, row_height


def store_of(units, style=b"\xff"):
    return B.pack_store([B.TEXT + len(units).to_bytes(4, "big") + b"".join(u.to_bytes(2, "big") for u in units) + style])


def read(store):
    (raw, style), *_ = B.text_pieces(store)
    units = [int.from_bytes(raw[k : k + 2], "big") for k in range(0, len(raw), 2)]
    return T.tree(units, B.style_spans(style, len(units)))


def test_styles_follow_their_characters():
    bold = {20: T.ON | 1 << T.BOLD_SHIFT}
    units = T.units_of("one two three") + [T.LINE_END]
    store = store_of(units, save.encoded_style([(4, {20: T.ON}), (3, bold), (7, {20: T.ON})]))
    runs = lambda s: [(r["text"], r["bold"]) for r in read(s)[0]["runs"]]
    assert runs(store) == [("one ", False), ("two", True), (" three", False)]
    assert runs(save.saved(store, lambda t: t.replace("two", "twice"))) == [("one ", False), ("twice", True), (" three", False)]
    assert runs(save.saved(store, lambda t: t.replace("one ", ""))) == [("two", True), (" three", False)]
    assert save.saved(store, lambda t: t) and runs(save.saved(store, lambda t: t)) == runs(store)


def test_refusals_and_tables():
    units = T.table_units([["left", "right"], ["a", "b"]]) + T.units_of("see ") + T.with_reading("base", "reading") + [T.LINE_END]
    with pytest.raises(save.Refused):
        save.saved(store_of(units), lambda t: t.replace("base", "x"))
    with pytest.raises(save.Refused):
        save.saved(store_of(units), lambda t: t.replace("left", "l\nr"))
    after = read(save.saved(store_of(units), lambda t: t.replace("left", "🙂 longer")))
    assert [r.get("text") for r in after] == ["🙂 longer", "right", "a", "b", "see base"]


def test_style_that_goes_is_switched_off():
    events = B.style_events(save.encoded_style([(2, {20: T.ON, 2: 423}), (3, {})]))
    assert events == [("set", [(2, 423), (20, T.ON)]), ("keep", 1), ("set", [(2, 0), (20, 0)]), ("keep", 2)]


def test_pdf_text_layer():
    data = pdf.text_pdf([[(40, 40, 10.5, "ab a")], [(40, 40, 10.5, "漢🙂")]], title="t")
    assert data.startswith(b"%PDF-") and data.count(b"/Type /Page ") == 2
    table = zlib.decompress(re.search(rb"/FlateDecode >>\nstream\n(.*?)\nendstream", data, re.S)[1])
    assert b"<0001> <0061>" in table and b"<0005> <D83DDE42>" in table
    start = int(re.search(rb"startxref\n(\d+)", data)[1])
    assert data[start : start + 4] == b"xref"
    for k, place in enumerate(re.findall(rb"(\d{10}) 00000 n", data), 1):
        assert data[int(place) :].startswith(b"%d 0 obj" % k)


def test_page_flow():
    assert placed([(60, False), (60, False), (60, True), (200, False)], 100) == [(0, 0, 0.0), (1, 0, 0.0), (2, 0, 0.0), (3, 0, 0.0)]
    assert placed([(60, False)] * 3, 100, 2) == [(0, 0, 0.0), (0, 1, 0.0), (1, 0, 0.0)]
    assert placed([(10, True), (10, False)], 100) == [(0, 0, 0.0), (0, 0, 10.0)]
    assert row_height([(["aaaaaa", "b"], 4), ([], 4)], 10) == 30 and row_height([], 10) == 10


def test_page_setup_streams():
    from docframe.decode import pagesetup as P

    assert P.parsed(b"") is None and P.parsed(b"x" * 40) is None
    given = P.PageSetup(42000, 29700, [1, 2, 3, 4], 90, 30, 500, 370, True, 2, 2, 800, True, {2: (1, 900), 6: (2, 700)})
    assert P.parsed(P.setup_stream(given)) == given
    for k in range(len(P.setup_stream(given))):  # cut anywhere
        P.parsed(P.setup_stream(given)[:k])
    unknown = P.parsed(P.stream([(P.MARGINS, b"\0" + bytes([0x78]) + bytes(range(8)) + b"\x01\x01"), (0x4242, b"?"), (P.PAPER, b"\x11\0")]))
    assert unknown.margins == [1, 0x203, 0x405, 0x607] and not unknown.vertical and unknown.width == 21000


def test_frames_pictures_and_damaged_streams():
    from docframe.decode import frames as D

    rows = [{"id": 3, "kind": 1, "item": 4, "x": -5, "y": 6, "w": 7, "h": 8, "on_text": True, "fixed": True, "wrap": True, "wrap_blank": False}]
    assert D.frames(D.frames_bytes(rows)) == rows
    assert D.embeddings(D.embeddings_bytes([(0, 1), (3, 4)])) == [(0, 1), (3, 4)]
    gif = b"GIF89a\x01\0\x01\0\0\0\0\0;....."
    assert D.picture(b"\x08\0\x01\0\0\0\0\0C:\\x.gif\0" + len(gif).to_bytes(4, "little") + gif + b"rest") == ("image/gif", gif)
    assert D.picture(b"BMnothing") is None and D.picture(b"....\x89PNG") == ("image/png", b"\x89PNG")
    assert D.background(D.background_bytes((1, 2, 3))) == {"color": "#010203"} and D.background(b"") == {}
    assert D.anchor([0, 0x30, 0xFFFF, 0x507, 0x12, 5, 0]) == 5 and D.anchor([0, 0x31, 0, 0x507, 0, 5]) is None
    for data, read in ((D.frames_bytes(rows), D.frames), (D.embeddings_bytes([(1, 2)]), D.embeddings), (D.background_bytes((1, 2, 3), path="ab"), D.background)):
        for k in range(len(data)):
            read(data[:k])

"""The block tree on hand-made unit streams, and error and warning rows of files."""

from docframe.decode import blocks, blocktree as T, container
from docframe.limits import Limits
from docframe.sources import files


def shown(units, *names):
    return [tuple(r.get(n) for n in names) for r in T.tree(units)]


def test_tables_cells_and_what_follows():
    units = T.paragraph_units("題名", "center") + T.table_units([["左", "右"], ["下", ""]]) + T.paragraph_units("本文")
    assert shown(units, "block_no", "row_no", "cell_no", "text", "align") == [(0, None, None, "題名", "center"), (1, 0, 0, "左", "left"), (1, 0, 1, "右", "left"), (1, 1, 0, "下", "left"), (1, 1, 1, None, None), (2, None, None, "本文", "left")]


def test_one_column_is_unwrapped_and_takes_the_page_break():
    units = T.paragraph_units("a") + [T.PAGE] + T.table_units([["x"], [""], ["y"]]) + T.paragraph_units("b")
    assert shown(units, "block_no", "row_no", "text", "page_break_before") == [(0, None, "a", False), (1, None, "x", True), (2, None, "", False), (3, None, "y", False), (4, None, "b", False)]


def test_several_paragraphs_in_a_cell_and_two_tables():
    two = T.table_units([["a\nb", "c"]])
    assert shown(two + [T.STOP] + two, "block_no", "cell_no", "para_no", "text") == [(0, 0, 0, "a"), (0, 0, 1, "b"), (0, 1, 0, "c"), (1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "c")]
    assert [r[0] for r in shown(two + two, "block_no")] == [0] * 6


def test_readings_and_line_headers():
    u = T.units_of
    units = T.line_record((T.ALIGN, [1])) + u("題名") + T.with_reading("切符", "きっぷ") + [T.LINE_END] + u("後") + [T.LINE_END]
    first, second = T.tree(units)
    assert first["runs"][1] == {"text": "切符", "reading": "きっぷ", "bold": False} and (first["align"], second["align"]) == ("center", "left")
    inside = u("前") + T.line_record((T.ALIGN, [1])) + [T.LINE_END] + u("中央") + [T.LINE_END] + u("後") + [T.LINE_END]
    assert [r["align"] for r in T.tree(inside)] == ["left", "center", "left"]


def test_trailing_empty_and_nothing():
    assert shown(T.paragraph_units("a") + [T.LINE_END] * 3, "text") == [("a",)]
    assert shown([], "text") == [("",)]


def test_rule_items():
    items = T.rule_items([160, 0, 5, 19, 1, 0, 76, 19, 0, 0, 76, 19, 0])
    assert items == ((19, 1, 0, 76), (19, 0, 0, 76), (19, 0, 0, 0)) and T.rule_width(5, items) == 5 + 1 + 79 + 78 + 1


def test_error_and_warning_rows(spark, tmp_path):
    sheet = blocks.text_store("abc")
    many = {"/DocumentText": sheet, "/a/DocumentText": b"damaged", "/b/DocumentText": blocks.text_store("x" * 50), "/c/DocumentText": sheet}
    for name, content in (("ok.jtd", container.write_container(many)), ("large.jtd", b"x" * 20_000), ("bad.jtd", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\xff" * 600)):
        (tmp_path / name).write_bytes(content)
    scanned = files.scan(spark, str(tmp_path), "*.jtd", 15_000)
    assert scanned.count() == 3
    rows = files.paragraphs(scanned, Limits(max_sheets=3, max_text_units=20)).collect()
    by = lambda n: [(r["sheet_no"], r["text"], r["error_class"]) for r in rows if r["path"].endswith(n)]
    assert by("large.jtd") == [(None, None, "TooLarge")]
    assert len(by("bad.jtd")) == 1 and by("bad.jtd")[0][2]
    assert by("ok.jtd") == [(0, "abc", None), (1, None, "Warning"), (2, None, "Warning")]
    rows = files.paragraphs(scanned.where("path like '%ok.jtd'"), Limits(max_sheets=3)).collect()
    assert [r["error_class"] for r in rows] == [None, "Warning", None, "Warning"]

"""Sequence operators, line breaking and edits against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from docframe.decode.errors import TooLarge
from docframe.functions import edits, lines
from docframe.operators import sequences as S
from docframe.plans.catalogue import QUERIES
from tests.conftest import SMALL


def test_as_of_running_and_nearest_by_cells(spark):
    rnd = random.Random(1)
    left = [(k, rnd.randrange(3), rnd.randrange(100)) for k in range(200)]
    right = [(rnd.randrange(3), rnd.randrange(100), rnd.randrange(1000)) for _ in range(60)]
    a, b = spark.createDataFrame(left, "id long, k long, t long"), spark.createDataFrame(right, "k long, t long, v long")
    expected = {(i, max(((u, v) for j, u, v in right if j == k and u <= t), default=(0, None))[1]) for i, k, t in left}
    for cell in (None, lambda t: F.floor(t / 7)):
        assert {(r["id"], r["found"]) for r in S.as_of(a, b, "k", "t", "v", "found", cell).collect()} == expected
        near = S.nearest(a, b, "k", "t", "v", "no", "far", cell).collect()
        assert len(near) == len(left)
        for r in near:
            far, no = min((abs(u - r["t"]), v) for j, u, v in right if j == r["k"])
            assert (r["far"], r["no"]) == (far, no)
    sums = lambda cell: {(r["id"], r["s"]) for r in S.running(a, ["k"], ["t", "id"], F.col("id"), "s", cell=cell).collect()}
    assert sums(None) == sums(F.floor(F.col("t") / 9))


def broken_by_force(text, width):
    size = [8 if c == "\t" else 1 if " " <= c <= "~" or "\xa0" <= c <= "ɏ" or "｡" <= c <= "ﾟ" else 2 for c in text]
    for k in range(len(text) - 1):
        if text[k] in lines.CLOSING and text[k + 1] in lines.CLOSING + lines.OPENING:
            size[k] = 1
    out, start = [], 0
    while True:
        at, used = start, 0
        while at < len(text) and (used + size[at] <= width or at == start):
            used, at = used + size[at], at + 1
        if at >= len(text):
            return out + [(start, len(text))] if start < len(text) or not out else out
        cut = at
        if text[at] in lines.HANGING:
            cut += 1
        elif text[at] in lines.NOT_FIRST and cut - start > 1:
            cut -= 1
        while cut - start > 1 and text[cut - 1] in lines.NOT_LAST:
            cut -= 1
        out.append((start, cut))
        start = cut
        if start == len(text):
            return out


def test_line_breaking_by_force():
    rnd = random.Random(2)
    for _ in range(4000):
        text = "".join(rnd.choice("ab 、。）（「」あ漢ー!,.\t(") for _ in range(rnd.randrange(40)))
        width = rnd.choice([2, 5, 8, 10])
        assert lines.break_lines(text, width) == broken_by_force(text, width), (text, width)


def test_marks_at_line_ends():
    assert lines.break_lines("ああああ。い", 8) == [(0, 5), (5, 6)]
    assert lines.break_lines("あああああー", 10) == [(0, 4), (4, 6)]
    assert lines.break_lines("あああ（い", 8) == [(0, 3), (3, 5)]
    assert lines.break_lines("", 8) == [(0, 0)]


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b):
            before, row[k + 1] = row[k + 1], before + 1 if x == y else max(row[k], row[k + 1])
    return row[-1]


def test_shortest_scripts_by_force():
    rnd = random.Random(3)
    for _ in range(500):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(14))] for _ in range(2))
        script = edits.difference(a, b)
        assert sum(n for op, _, n in script if op == "keep") == common_length(a, b)
        out = [x for op, at, n in script if op != "delete" for x in (a if op == "keep" else b)[at : at + n]]
        assert out == b


def test_common_ends_by_force():
    rnd = random.Random(4)
    for _ in range(2000):
        a, b = ("".join(rnd.choice("ab") for _ in range(rnd.randrange(12))) for _ in range(2))
        first = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        rest = min(len(a), len(b)) - first
        last = next((k for k in range(rest) if a[-1 - k] != b[-1 - k]), rest)
        assert edits.common_ends(a, b) == (first, last)
    long = "x" * 300_000
    assert edits.common_ends(long, long + "y") == (300_000, 0) and edits.common_ends("a" + long, "b" + long) == (0, 300_000)


def test_replace_rescans_and_is_bounded():
    assert edits.replace_all("a    b", "  ", " ") == ("a b", 3)
    assert edits.replace_all("and and", "and", "&and") == ("&and and", 1)
    with pytest.raises(TooLarge):
        edits.replace_all("a" * 40 + "b", "ab", "bba")


def test_greedy_bands():
    assert edits.greedy_bands([100, 100, 5000], [110, 5050, 95]) == [0, 2, 1]
    assert edits.greedy_bands([100, 9000, 200], [100, 500, 210]) == [0, 1, 2]
    assert edits.greedy_bands([1], []) == [None]


def test_alignment_and_normalised_by_force(spark):
    import difflib
    import re
    import unicodedata

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    for r in QUERIES["q36_alignment"](spark, SMALL).collect():
        a, b = ("".join(x.split()) for x in (docs[r["item_id"]], items[r["item_id"]]))
        assert r["n_matched"] == sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    for r in QUERIES["q46_normalised"](spark, SMALL).collect():
        bare = re.sub("[ \t\n\x0b\f\r　─-╿]", "", docs[r["doc_id"]])
        assert r["n_visible"] == len("".join(unicodedata.normalize("NFKC", c) for c in bare))

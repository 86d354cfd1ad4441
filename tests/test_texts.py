"""Other text files, batch edits, differences."""

import random

import pytest

from docframe.decode import texts
from docframe.decode.errors import Corrupt
from docframe.functions.edits import difference, replace_all


def test_plain_text():
    for text, encoding in (("日本語", "utf-8"), ("日本語テキスト", "cp932"), ("abc", "ascii")):
        assert texts.plain_text(text.encode(encoding)) == text


def test_rtf():
    data = rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}{\*\generator x;}Caf\'e9 \u8364? 5\par{\b bold}\tab \{x\}\par}"
    assert texts.rtf_text(data) == "Café € 5\nbold\t{x}"
    assert texts.rtf_text(b"}}{\\") == ""


def test_docx():
    data = texts.docx([("a<b\tc", False), ("\x01d", True)])
    assert "".join(c for c, _ in texts.docx_characters(data)) == "a<b\tc\nd\n"
    with pytest.raises(Corrupt):
        texts.docx_characters(b"PK nothing")


def test_replace_all():
    assert replace_all("aaa", "a", "b") == ("bbb", 3)
    assert replace_all("aaa", "a", "aa") == ("aaaa", 1)
    assert replace_all("aabb", "ab", "") == ("", 2)
    assert replace_all("x", "", "y") == ("x", 0)


def applied(ops, a, b):
    return [x for op, at, n in ops if op != "delete" for x in (b if op == "insert" else a)[at : at + n]]


def test_difference():
    rnd = random.Random(1)
    for _ in range(400):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randrange(12))] for _ in range(2))
        ops = difference(a, b)
        assert applied(ops, a, b) == b
        assert [x for op, at, n in ops if op != "insert" for x in a[at : at + n]] == a
        kept = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                kept[i + 1][j + 1] = kept[i][j] + 1 if a[i] == b[j] else max(kept[i][j + 1], kept[i + 1][j])
        assert sum(n for op, _, n in ops if op == "keep") == kept[-1][-1]
    assert applied(difference("a" * 50, "b" * 50, most=3), "a" * 50, "b" * 50) == list("b" * 50)

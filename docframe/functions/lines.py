"""Line breaking by half cells, with marks that may hang over the end of a line or must not begin or end one."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

# Marks that may hang, marks that must not begin a line, brackets that must not end one, and closing and
# opening marks of which the first take half their width right before another.
HANGING = "、。，．,."
NOT_FIRST = "、。，．,.)）]］｝」』】〕〉》〙〗’”ゝゞーァィゥェォッャュョヮヵヶぁぃぅぇぉっゃゅょゎゕゖ・：；？！!?"
NOT_LAST = "(（[［｛「『【〔〈《〘〖‘“"
CLOSING, OPENING = "、。，．）」』】〕〉》", "（「『【〔〈《"
_ONE = "\x20-\x7e\uff61-\uff9f\xa0-\u024f"
_OTHERS = re.compile(f"[^{_ONE}]")
_SQUEEZED = re.compile(f"[{CLOSING}](?=[{CLOSING}{OPENING}])")


def cells(text: str) -> list[int] | None:
    """Half cells of each character: 1 or 2, 8 for a tab; None if all take 1."""
    if not _OTHERS.search(text):
        return None
    out = [1] * len(text)
    for m in _OTHERS.finditer(text):
        out[m.start()] = 8 if m[0] == "\t" else 2
    for m in _SQUEEZED.finditer(text):
        out[m.start()] = 1
    return out


def break_lines(text: str, width: int) -> list[tuple[int, int]]:
    """(start, end) of each line of at most `width` half cells; an empty text has one line.

    A mark that must not begin a line hangs, if it may, else takes the character before it along; brackets that must not
    end a line go to the next.
    """
    n, sizes = len(text), cells(text)
    ends = None if sizes is None else list(accumulate(sizes, initial=0))
    out, start = [], 0
    while start < n:
        at = start + width if ends is None else bisect_right(ends, ends[start] + width) - 1
        at = cut = max(at, start + 1)
        if at >= n:
            break
        c = text[at]
        if c in NOT_FIRST:
            if c in HANGING:
                cut += 1
            elif cut - start > 1:
                cut -= 1
        while cut - start > 1 and text[cut - 1] in NOT_LAST:
            cut -= 1
        out.append((start, cut))
        start = cut
    if start < n or not out:
        out.append((start, n))
    return out

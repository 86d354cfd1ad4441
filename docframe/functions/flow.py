"""Lines and table rows placed on pages and in columns."""

from __future__ import annotations

from collections.abc import Iterable

from docframe.functions.lines import break_lines


def placed(heights: Iterable[tuple[float, bool]], page_height: float, columns: int = 1) -> list[tuple[int, int, float]]:
    """(page, column, top) of each (height, page break before it) in order.

    What doesn't fit goes to the next column, then to the next page; something higher than a page has one of its own.
    """
    page = column = 0
    top, out, empty = 0.0, [], True
    for height, broken in heights:
        if broken and not (empty and column == 0):
            page, column, top, empty = page + 1, 0, 0.0, True
        if not empty and top + height > page_height + 0.01:
            column, top = column + 1, 0.0
            if column == columns:
                page, column = page + 1, 0
        out.append((page, column, top))
        top, empty = top + height, False
    return out


def row_height(cells: list[tuple[list[str], int]], line: float) -> float:
    """The height of a table row: its highest cell's lines, at least one. cells: paragraphs and width in half cells."""
    return line * max([1, *(sum(len(break_lines(p, max(2, width))) for p in paragraphs) for paragraphs, width in cells)])

"""Sinks: paragraphs assembled in order to text, Markdown, HTML or JSON, one row by file.

Paragraphs have path, sheet_no, para_no, text and page_break_before, as docframe.sources.files.paragraphs gives them; rows
with an error are left out. Everything is one aggregation by file over sorted arrays, inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def escaped(text: Column, quotes: bool = True) -> Column:
    """Text for HTML or XML."""
    for raw, put in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;")] if quotes else [])):
        text = F.replace(text, F.lit(raw), F.lit(put))
    return text


def _sheets(paragraphs: DataFrame) -> DataFrame:
    """path, sheets: array of (sheet_no, paras: array of (para_no, text, page_break_before)), both in order."""
    rows = paragraphs.where("para_no is not null")
    para = F.struct("para_no", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("page_break_before", F.lit(False)).alias("brk"))
    by_sheet = rows.groupBy("path", "sheet_no").agg(F.array_sort(F.collect_list(para)).alias("paras"))
    return by_sheet.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("sheet_no", "paras"))).alias("sheets"))


def _assembled(paragraphs: DataFrame, name: str, para, banner, between: str) -> DataFrame:
    """para(p): the text of a paragraph; banner(sheet): before a sheet, if there are several."""
    several = F.size("sheets") > 1
    sheet = lambda s: F.concat(F.when(several, banner(s)).otherwise(F.lit("")), F.array_join(F.transform(s["paras"], para), between))
    return _sheets(paragraphs).select("path", F.array_join(F.transform("sheets", sheet), "\n").alias(name))


def plain_text(paragraphs: DataFrame) -> DataFrame:
    """path, body: lines, a form feed before a page break, a banner before each of several sheets."""
    return _assembled(
        paragraphs,
        "body",
        lambda p: F.concat(F.when(p["brk"], F.lit("\f")).otherwise(F.lit("")), p["text"]),
        lambda s: F.concat(F.lit("=== sheet "), (s["sheet_no"] + 1).cast("string"), F.lit(" ===\n")),
        "\n",
    )


def markdown(paragraphs: DataFrame) -> DataFrame:
    """path, body: paragraphs apart by an empty line, a rule before a page break, a head before each of several sheets."""
    return _assembled(
        paragraphs,
        "body",
        lambda p: F.concat(F.when(p["brk"], F.lit("---\n\n")).otherwise(F.lit("")), F.replace(p["text"], F.lit("|"), F.lit("\\|"))),
        lambda s: F.concat(F.lit("## Sheet "), (s["sheet_no"] + 1).cast("string"), F.lit("\n\n")),
        "\n\n",
    )


def html(paragraphs: DataFrame) -> DataFrame:
    """path, body: a fragment of escaped paragraphs; an empty one keeps its line."""
    return _assembled(
        paragraphs,
        "body",
        lambda p: F.concat(F.when(p["brk"], F.lit('<hr class="page">')).otherwise(F.lit("")), F.lit("<p>"), F.when(p["text"] == "", F.lit("<br>")).otherwise(escaped(p["text"])), F.lit("</p>")),
        lambda s: F.concat(F.lit("<h2>Sheet "), (s["sheet_no"] + 1).cast("string"), F.lit("</h2>\n")),
        "\n",
    )


def json_model(paragraphs: DataFrame) -> DataFrame:
    """path, body: sheets with their blocks; defaults are left out."""
    block = lambda p: F.struct(F.lit("paragraph").alias("type"), p["text"].alias("text"), F.when(p["brk"], F.lit(True)).alias("page_break_before"))
    return _sheets(paragraphs).select("path", F.to_json(F.struct(F.transform("sheets", lambda s: F.struct(F.transform(s["paras"], block).alias("blocks"))).alias("sheets"))).alias("body"))


# Sinks of whole documents: paragraphs with runs and tables, as docframe.sources.files.tree gives them.


def _bodies(tree: DataFrame, paragraph, cell, table, banner) -> DataFrame:
    """path, body. paragraph(runs, row) -> Column; cell(its paragraphs' texts, row); table(rows of cells); banner(sheet_no).

    Everything is grouped under the path, so that one shuffle by path serves all steps.
    """
    rows = tree.where("block_no is not null").repartition("path")
    plain = rows.where("row_no is null").select("path", "sheet_no", "block_no", paragraph(F.col("runs")).alias("part"))
    place = ["path", "sheet_no", "block_no", "row_no"]
    cells = rows.where("row_no is not null").withColumn("t", F.when(F.col("para_no").isNotNull(), F.struct("para_no", cell(F.col("runs")).alias("s"))))
    cells = cells.groupBy(*place, "cell_no").agg(F.array_sort(F.collect_list("t")).alias("t"), F.min("cell_left").alias("l"), F.max("cell_right").alias("r"), F.bool_or("ruled").alias("ruled"))
    following = F.lead("l").over(Window.partitionBy(*place).orderBy("cell_no"))
    cells = cells.withColumn("r", F.greatest(F.coalesce(following, "r"), F.col("l") + 1))
    one = F.struct("cell_no", "l", "r", F.transform("t", lambda x: x["s"]).alias("t"))
    by_row = cells.groupBy(*place).agg(F.array_sort(F.collect_list(one)).alias("cells"), F.bool_or("ruled").alias("ruled"))
    tables = by_row.groupBy(*place[:3]).agg(F.array_sort(F.collect_list(F.struct("row_no", "cells", "ruled"))).alias("rows")).select(*place[:3], table(F.col("rows")).alias("part"))
    blocks = plain.unionByName(tables).groupBy("path", "sheet_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "part"))), lambda b: b["part"]), "").alias("body"))
    sheets = F.array_sort(F.collect_list(F.struct("sheet_no", "body")))
    return blocks.groupBy("path").agg(sheets.alias("s")).select("path", F.array_join(F.transform("s", lambda x: F.concat(F.when(F.size("s") > 1, banner(x["sheet_no"] + 1)).otherwise(""), x["body"])), "").alias("body"))


def _joined(runs: Column, one) -> Column:
    return F.array_join(F.transform(runs, one), "")


def document_text(tree: DataFrame) -> DataFrame:
    """path, body: lines; the cells of a row parted by a tab, their paragraphs by a slash; readings are left out."""
    text = lambda runs: _joined(runs, lambda r: r["text"])
    row = lambda r: F.concat(F.array_join(F.transform(r["cells"], lambda c: F.array_join(c["t"], " / ")), "\t"), F.lit("\n"))
    return _bodies(
        tree,
        lambda runs: F.concat(F.when(F.col("page_break_before"), "\f").otherwise(""), text(runs), F.lit("\n")),
        text,
        lambda rows: F.array_join(F.transform(rows, row), ""),
        lambda no: F.concat(F.lit("=== sheet "), no.cast("string"), F.lit(" ===\n")),
    )


def document_markdown(tree: DataFrame) -> DataFrame:
    """path, body: bold runs, readings in brackets, a table's first row as its head, short rows padded."""

    def text(runs):
        with_reading = lambda r: F.when(r["reading"].isNotNull(), F.concat(r["text"], F.lit("\uff08"), r["reading"], F.lit("\uff09"))).otherwise(r["text"])
        bare = lambda r: F.regexp_replace(with_reading(r), r"^\s+|\s+$", "")
        return _joined(runs, lambda r: F.when(r["bold"] & (bare(r) != ""), F.concat(F.lit("**"), bare(r), F.lit("**"))).otherwise(with_reading(r)))

    def table(rows):
        n = F.array_max(F.transform(rows, lambda r: F.size(r["cells"])))
        own = lambda r: F.transform(r["cells"], lambda c: F.replace(F.array_join(c["t"], "<br>"), F.lit("|"), F.lit("\\|")))
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(own(r), F.array_repeat(F.lit(""), n - F.size(r["cells"]))), " | "), F.lit(" |\n"))
        head = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), n), F.lit("\n"))
        return F.concat(F.array_join(F.transform(rows, lambda r, k: F.concat(line(r), F.when(k == 0, head).otherwise(""))), ""), F.lit("\n"))

    return _bodies(
        tree,
        lambda runs: F.concat(F.when(F.col("page_break_before"), "---\n\n").otherwise(""), F.regexp_replace(text(runs), r"\s+$", ""), F.lit("\n\n")),
        text,
        table,
        lambda no: F.concat(F.lit("## Sheet "), no.cast("string"), F.lit("\n\n")),
    )


def document_html(tree: DataFrame) -> DataFrame:
    """path, body: a fragment with alignment, bold, readings as ruby, and tables whose cells span the columns they cover."""

    def run(r):
        body = F.when(r["reading"].isNotNull(), F.concat(F.lit("<ruby>"), escaped(r["text"]), F.lit("<rt>"), escaped(r["reading"]), F.lit("</rt></ruby>"))).otherwise(escaped(r["text"]))
        return F.when(r["bold"], F.concat(F.lit("<b>"), body, F.lit("</b>"))).otherwise(body)

    def paragraph(runs):
        style = F.when(F.col("align").isin("center", "right"), F.concat(F.lit(' style="text-align:'), F.col("align"), F.lit('"'))).otherwise("")
        inner = _joined(runs, run)
        return F.concat(F.lit("<p"), style, F.lit(">"), F.when(F.trim(inner) == "", "&nbsp;").otherwise(inner), F.lit("</p>"))

    def table(rows):
        edges = F.array_sort(F.array_distinct(F.flatten(F.transform(rows, lambda r: F.flatten(F.transform(r["cells"], lambda c: F.array(c["l"], c["r"])))))))
        last = F.size(edges) - 1
        width = lambda k: (F.get(edges, k + 1) - F.get(edges, k)) / F.greatest(F.get(edges, last) - F.get(edges, F.lit(0)), F.lit(1)) * 100
        cols = F.array_join(F.transform(F.sequence(F.lit(0), last - 1), lambda k: F.format_string('<col style="width:%.2f%%">', width(k).cast("double"))), "")
        gap = lambda n: F.when(n > 0, F.format_string('<td class="gap" colspan="%d"></td>', n.cast("int"))).otherwise("")
        place = lambda x: (F.array_position(edges, x) - 1).cast("int")

        def put(done, c):
            a = place(c["l"])
            span = F.greatest(place(c["r"]) - a, F.lit(1))
            return F.struct(F.concat(done["html"], gap(a - done["at"]), F.format_string('<td colspan="%d">', span), F.array_join(c["t"], ""), F.lit("</td>")).alias("html"), (a + span).alias("at"))

        start = F.struct(F.lit("").alias("html"), F.lit(0).alias("at"))
        row = lambda r: F.concat(F.when(r["ruled"], '<tr class="ruled">').otherwise("<tr>"), F.aggregate(r["cells"], start, put, lambda d: F.concat(d["html"], gap(last - d["at"]))), F.lit("</tr>"))
        return F.concat(F.lit("<table><colgroup>"), cols, F.lit("</colgroup>"), F.array_join(F.transform(rows, row), ""), F.lit("</table>"))

    return _bodies(
        tree,
        lambda runs: F.concat(F.when(F.col("page_break_before"), '<hr class="page">').otherwise(""), paragraph(runs)),
        paragraph,
        table,
        lambda no: F.concat(F.lit("<h2>Sheet "), no.cast("string"), F.lit("</h2>")),
    )


def page(body: DataFrame, title: Column) -> DataFrame:
    """path, body: the fragments as whole HTML pages."""
    head = F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), escaped(title), F.lit("</title></head><body>"))
    return body.select("path", F.concat(head, "body", F.lit("</body></html>")).alias("body"))


def report(df: DataFrame, folder: str) -> None:
    """A tab-separated table with a head, written by the executors."""
    df.write.mode("append").option("sep", "\t").option("header", "true").csv(folder)

"""Queries on written documents with formats, readings, tables and page breaks: one file for each supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.decode import blocks, blocktree as T
from docframe.plans.registry import query, table
from docframe.sources import exports, files


def _store(row):
    """A bold centred name, a table of two rows, a page break, and a line with a reading."""
    head = T.line_record((T.ALIGN, [1]))
    units = head + T.units_of(row["name"]) + [T.LINE_END] + T.table_units([["key", row["key"]], ["nation", row["nation"]]]) + [T.PAGE]
    units += T.units_of("see ") + T.with_reading(row["nation"], f"r{row['nation']}") + [T.LINE_END]
    style = blocks.style_bytes([("keep", len(head)), ("set", [(20, T.ON | 1 << T.BOLD_SHIFT)]), ("keep", len(row["name"]) - 1), ("set", [(20, 0)])])
    raw = b"".join(u.to_bytes(2, "big") for u in units)
    return blocks.pack_store([blocks.TEXT + len(units).to_bytes(4, "big") + raw + style])


def _files(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return files.written(s.select(F.concat(F.lit("/"), "s_suppkey", F.lit(".jtd")).alias("path"), F.col("s_name").alias("name"), F.col("s_suppkey").cast("string").alias("key"), F.col("s_nationkey").cast("string").alias("nation")), _store)


def _key():
    return F.regexp_extract("path", r"/(\d+)\.jtd$", 1).cast("bigint").alias("s_suppkey")


@query("""
SELECT s_suppkey, b.block_no, b.row_no, b.cell_no, CASE WHEN b.block_no = 0 THEN s_name WHEN b.block_no = 2 THEN concat('see ', s_nationkey) WHEN b.cell_no = 0 THEN CASE b.row_no WHEN 0 THEN 'key' ELSE 'nation' END WHEN b.row_no = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE CAST(s_nationkey AS VARCHAR) END AS text,
  CASE b.block_no WHEN 0 THEN 'center' ELSE 'left' END AS align, b.block_no = 2 AS page_break, b.block_no = 0 AS bold, CASE b.block_no WHEN 2 THEN concat('r', s_nationkey) END AS reading, b.cell_no * 80 + 2 AS cell_left
FROM supplier, (VALUES (0, NULL, NULL), (1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1), (2, NULL, NULL)) b(block_no, row_no, cell_no)
""")
def d10_blocks(spark, sf_dir):
    """Paragraphs and table cells of each file, with format, bold, reading, page break and cell edge."""
    t = files.tree(_files(spark, sf_dir))
    return t.select(_key(), "block_no", "row_no", "cell_no", "text", "align", F.col("page_break_before").alias("page_break"), F.exists("runs", lambda r: r["bold"]).alias("bold"), F.array_max(F.transform("runs", lambda r: r["reading"])).alias("reading"), "cell_left")


@query(r"""
SELECT s_suppkey, concat(s_name, chr(10), 'key', chr(9), s_suppkey, chr(10), 'nation', chr(9), s_nationkey, chr(10), chr(12), 'see ', s_nationkey, chr(10)) AS body FROM supplier
""")
def d11_document_text(spark, sf_dir):
    return exports.document_text(files.tree(_files(spark, sf_dir))).select(_key(), "body")


@query("""
SELECT s_suppkey, concat('**', s_name, '**', chr(10), chr(10), '| key | ', s_suppkey, ' |', chr(10), '| --- | --- |', chr(10), '| nation | ', s_nationkey, ' |', chr(10), chr(10), '---', chr(10), chr(10), 'see ', s_nationkey, '（r', s_nationkey, '）', chr(10), chr(10)) AS body FROM supplier
""")
def d12_document_markdown(spark, sf_dir):
    return exports.document_markdown(files.tree(_files(spark, sf_dir))).select(_key(), "body")


@query("""
SELECT s_suppkey, concat('<!doctype html><html><head><meta charset="utf-8"><title>', s_suppkey, '</title></head><body><p style="text-align:center"><b>', s_name, '</b></p><table><colgroup><col style="width:51.28%"><col style="width:48.72%"></colgroup><tr class="ruled"><td colspan="1"><p>key</p></td><td colspan="1"><p>', s_suppkey,
  '</p></td></tr><tr class="ruled"><td colspan="1"><p>nation</p></td><td colspan="1"><p>', s_nationkey, '</p></td></tr></table><hr class="page"><p>see <ruby>', s_nationkey, '<rt>r', s_nationkey, '</rt></ruby></p></body></html>') AS body FROM supplier
""")
def d13_document_html(spark, sf_dir):
    body = exports.document_html(files.tree(_files(spark, sf_dir)))
    return exports.page(body, F.regexp_extract("path", r"/(\d+)", 1)).select(_key(), "body")


@query("""
SELECT doc_id, CAST(to_json({'sheets': [{'blocks': list_transform(p, lambda t: {'type': 'paragraph', 'text': t})}]}) AS VARCHAR) AS body FROM (
  SELECT doc_id, l[1:coalesce(list_max([CASE WHEN x <> '' THEN i ELSE 1 END FOR x, i IN l]), 1)] AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
""")
def d14_json_model(spark, sf_dir):
    """The JSON model of each document's file; the other engine's compact form."""
    from docframe.plans.decoded import decoded_paragraphs, doc_id

    return exports.json_model(decoded_paragraphs(spark, sf_dir)).select(doc_id(), "body")


@query("""
SELECT s_suppkey, CAST(sum(a + d + 2) + 1 AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n_items FROM (
  SELECT s_suppkey, 0 AS a, 76 AS d FROM supplier, range(2) UNION ALL SELECT s_suppkey, 0, -1 FROM supplier) GROUP BY s_suppkey
""")
def d15_rule_items(spark, sf_dir):
    """Items of the first ruled line of each file, and the width that they add up to."""
    t = files.tokens(_files(spark, sf_dir)).where("kind = 'record' and code = 16").select("path", "token_no", "words")
    # The tag and count of the rules stand after one word; values: width, 0, x0, then items of four words, the last of two.
    v = t.where("element_at(words, 2) = 143").withColumn("v", F.expr("slice(words, 4, element_at(words, 3))")).groupBy("path").agg(F.min_by("v", "token_no").alias("v"))
    items = v.withColumn("items", F.expr("transform(sequence(4, size(v) - 1, 4), k -> named_struct('a', if(k + 3 <= size(v), v[k], 0), 'd', if(k + 3 <= size(v), v[k + 2], v[k])))"))
    size = F.expr("aggregate(items, 0, (t, x) -> t + x.a + x.d + 2) - if(element_at(items, -1).a = 0 and element_at(items, -1).d = 0, 1, 0) + v[2] + 1")
    return items.select(_key(), size.cast("bigint").alias("total"), F.size("items").cast("bigint").alias("n_items"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS covered, CAST(CASE WHEN length(text) > 3 THEN 2 WHEN length(text) > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_spans, true AS whole FROM documents WHERE length(text) > 0")
def d37_style_coverage(spark, sf_dir):
    """The style spans of each file cover its units without gaps or overlaps: their lengths add up to the end of the last."""
    from docframe.plans.decoded import doc_id

    s = files.style_spans(files.containers(table(spark, sf_dir, "documents"))).where("unit_len is not null")
    end = F.max(F.col("unit_start") + F.col("unit_len"))
    return s.groupBy(doc_id()).agg(F.sum("unit_len").cast("bigint").alias("covered"), F.count("*").alias("n_spans"), (F.sum("unit_len") == end).alias("whole"))


@query("""
SELECT s_suppkey, tag, CAST(n AS BIGINT) AS n, CAST(n_values AS BIGINT) AS n_values FROM supplier, (VALUES (36, 1, 1), (143, 2, 26)) t(tag, n, n_values)
""")
def d38_line_tags(spark, sf_dir):
    """Tags of the line records of each file: after one word, tag, count and values until 0xFFFF, by a fold over the words."""
    words = files.tokens(_files(spark, sf_dir)).where("kind = 'record' and code = 16").select("path", "words")
    step = """aggregate(sequence(1, size(words)), named_struct('at', 1, 'found', array_repeat(named_struct('tag', 0, 'n', 0), 0)),
        (s, i) -> if(s.at + 1 >= size(words) or words[s.at] = 65535, s, named_struct('at', s.at + 2 + words[s.at + 1], 'found', array_append(s.found, named_struct('tag', words[s.at], 'n', words[s.at + 1])))), s -> s.found)"""
    tags = words.select("path", F.explode(F.expr(step)).alias("t"))
    return tags.groupBy(_key(), F.col("t.tag").alias("tag")).agg(F.count("*").alias("n"), F.sum("t.n").cast("bigint").alias("n_values"))


@query("""
SELECT s_suppkey, kind, text FROM (SELECT s_suppkey, 'visible' AS kind, CAST(s_nationkey AS VARCHAR) AS text FROM supplier UNION ALL SELECT s_suppkey, 'reading', concat('r', s_nationkey) FROM supplier)
""")
def d39_inline_kinds(spark, sf_dir):
    """Inline texts of each file by the two selector words of their heads."""
    t = files.tokens(_files(spark, sf_dir)).where("kind = 'inline'")
    a, b = F.get("words", F.lit(4)), F.get("words", F.lit(5))
    kind = F.when(b == 0x82, "reading").when((a == 1) & (b == 0), "hidden").otherwise("visible")
    return t.select(_key(), kind.alias("kind"), "text")

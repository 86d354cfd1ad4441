"""Text assembly and text analysis queries."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from docframe.cluster import spread
from docframe.operators.sequences import running
from docframe.plans.registry import query, sql_query, table

@query("""
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars,
       '=== conv ' || conv_id || ' ===' || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS body
FROM conversations GROUP BY conv_id
""")
def q02_text_assembly(spark, sf_dir):
    """Sheets of text with a banner, lines in their order."""
    t = table(spark, sf_dir, "conversations")
    lines = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return (
        t.groupBy("conv_id")
        .agg(F.count("*").alias("n_turns"), F.sum(F.length("text")).cast("bigint").alias("n_chars"), lines.alias("lines"))
        .select("conv_id", "n_turns", "n_chars", F.concat(F.lit("=== conv "), F.col("conv_id").cast("string"), F.lit(" ===\n"), F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")).alias("body"))
    )


sql_query(
    "q01_sniff",
    r"""SELECT src, kind, count(*) AS n, CAST(sum(controls) AS BIGINT) AS controls FROM (
      SELECT 'pages' AS src, CASE WHEN lower(substring(html, 1, 9)) = '<!doctype' THEN 'html5' WHEN lower(substring(html, 1, 5)) = '<html' THEN 'html' WHEN substring(html, 1, 1) = '<' THEN 'markup' ELSE 'text' END AS kind,
        length(substring(html, 1, 512)) - length(regexp_replace(substring(html, 1, 512), '[\\x00-\\x08\\x0b-\\x1f\\x7f]', '')) AS controls FROM {pages}
      UNION ALL
      SELECT 'documents', CASE WHEN substring(text, 1, 4) = '%PDF' THEN 'pdf' WHEN substring(text, 1, 2) = 'PK' THEN 'zip' WHEN substring(text, 1, 1) IN ('{{', '[') THEN 'json' WHEN substring(text, 1, 5) = '{{\\rtf' THEN 'rtf' ELSE 'text' END,
        length(substring(text, 1, 512)) - length(regexp_replace(substring(text, 1, 512), '[\\x00-\\x08\\x0b-\\x1f\\x7f]', '')) FROM {documents}) t GROUP BY src, kind""",
    r"""SELECT src, kind, count(*) AS n, CAST(sum(controls) AS BIGINT) AS controls FROM (
      SELECT 'pages' AS src, CASE WHEN lower(substring(html, 1, 9)) = '<!doctype' THEN 'html5' WHEN lower(substring(html, 1, 5)) = '<html' THEN 'html' WHEN substring(html, 1, 1) = '<' THEN 'markup' ELSE 'text' END AS kind,
        length(substring(html, 1, 512)) - length(regexp_replace(substring(html, 1, 512), '[\x00-\x08\x0b-\x1f\x7f]', '', 'g')) AS controls FROM {pages}
      UNION ALL
      SELECT 'documents', CASE WHEN substring(text, 1, 4) = '%PDF' THEN 'pdf' WHEN substring(text, 1, 2) = 'PK' THEN 'zip' WHEN substring(text, 1, 1) IN (chr(123), '[') THEN 'json' WHEN substring(text, 1, 5) = chr(123) || '\rtf' THEN 'rtf' ELSE 'text' END,
        length(substring(text, 1, 512)) - length(regexp_replace(substring(text, 1, 512), '[\x00-\x08\x0b-\x1f\x7f]', '', 'g')) FROM {documents}) t GROUP BY src, kind""",
)


def paragraphs(docs):
    """doc_id, para_no, text: lines after CRLF to LF, without empty ones at the end (one stays)."""
    lines = F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n", -1)
    full = F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform(lines, lambda x, i: F.when(x != "", i + 1).otherwise(0))), F.lit(1)))
    return docs.select("doc_id", F.posexplode(F.slice(lines, F.lit(1), full)).alias("para_no", "text"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, max(CASE WHEN line <> '' THEN i ELSE 1 END) OVER (PARTITION BY doc_id) AS last FROM l)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_paras, CAST(sum(length(line)) AS BIGINT) AS n_chars, CAST(max(length(line)) AS BIGINT) AS longest FROM k WHERE i <= last GROUP BY doc_id
""")
def q03_paragraphs(spark, sf_dir):
    n = F.length("text")
    return paragraphs(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_paras"), F.sum(n).cast("bigint").alias("n_chars"), F.max(n).cast("bigint").alias("longest"))


@query(r"""
WITH r AS (SELECT doc_id, regexp_extract_all(text, '[\x00-\x08\x0a-\x1f\x7f]+|[^\x00-\x08\x0a-\x1f\x7f]+') AS runs FROM documents),
u AS (SELECT doc_id, unnest(runs) AS run, generate_subscripts(runs, 1) AS i FROM r),
s AS (SELECT *, coalesce(sum(length(run)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM u)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS run_no, CASE WHEN regexp_matches(run, '^[\x00-\x08\x0a-\x1f\x7f]') THEN 'control' ELSE 'text' END AS kind, CAST(a AS BIGINT) AS start, CAST(a + length(run) AS BIGINT) AS "end" FROM s
""")
def q04_token_runs(spark, sf_dir):
    """Islands of text and of control characters, a tab being text."""
    control = r"[\x00-\x08\x0a-\x1f\x7f]"
    runs = F.regexp_extract_all("text", F.lit(rf"({control}+|[^\x00-\x08\x0a-\x1f\x7f]+)"), 1)
    u = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(runs).alias("i", "run"))
    s = running(u, ["doc_id"], ["i"], F.length("run"), "a")
    kind = F.when(F.col("run").rlike(f"^{control}"), "control").otherwise("text")
    return s.select("doc_id", F.col("i").cast("bigint").alias("run_no"), kind.alias("kind"), F.col("a").cast("bigint").alias("start"), (F.col("a") + F.length("run")).cast("bigint").alias("end"))


sql_query(
    "q14_escape",
    "SELECT page_id, CAST(length(e) AS BIGINT) AS n_chars, md5(e) AS digest FROM (SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS e FROM {pages}) t",
)
sql_query(
    "q15_markdown",
    r"""SELECT r_name, concat('| Key | Name |\n| --- | --- |\n', array_join(transform(array_sort(collect_list(struct(n_nationkey, n_name))), x -> concat('| ', x.n_nationkey, ' | ', replace(x.n_name, '|', '\\|'), ' |')), '\n')) AS body
    FROM {region} JOIN {nation} ON r_regionkey = n_regionkey GROUP BY r_name""",
    r"""SELECT r_name, '| Key | Name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || replace(n_name, '|', '\|') || ' |', chr(10) ORDER BY n_nationkey) AS body
    FROM {region} JOIN {nation} ON r_regionkey = n_regionkey GROUP BY r_name""",
)
sql_query(
    "q16_find",
    "SELECT doc_id, CAST(size(parts) - 1 AS BIGINT) AS n_found, CASE WHEN size(parts) > 1 THEN CAST(length(parts[0]) AS BIGINT) END AS first_at FROM (SELECT doc_id, split(text, 'the', -1) AS parts FROM {documents}) t",
    "SELECT doc_id, CAST(len(parts) - 1 AS BIGINT) AS n_found, CASE WHEN len(parts) > 1 THEN CAST(length(parts[1]) AS BIGINT) END AS first_at FROM (SELECT doc_id, string_split(text, 'the') AS parts FROM {documents}) t",
)
sql_query(
    "q17_replace_all",
    "SELECT doc_id, md5(replace(text, 'and', '&')) AS digest, CAST((length(text) - length(replace(text, 'and', ''))) / 3 AS BIGINT) AS n_replaced FROM {documents}",
    "SELECT doc_id, md5(replace(text, 'and', '&')) AS digest, CAST((length(text) - length(replace(text, 'and', ''))) // 3 AS BIGINT) AS n_replaced FROM {documents}",
)
# White space, and the ranges of the character classes from U+3000 on; closing and opening marks.
_WHITE = r"\t-\r\x20\x85\xA0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_RANGES = {"hiragana": r"\x{3040}-\x{309f}", "katakana": r"\x{30a0}-\x{30ff}\x{ff66}-\x{ff9f}", "han": r"\x{3005}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}", "wide": r"\x{ff10}-\x{ff5a}"}
_REST = r"\x{3001}-\x{3004}\x{3006}-\x{303f}\x{3100}-\x{33ff}\x{4dc0}-\x{4dff}\x{a000}-\x{ff0f}\x{ff5b}-\x{ff65}\x{ffa0}-\x{10ffff}"
CLASSES = {
    "space": f"[{_WHITE}]",
    **{name: f"[{r}]" for name, r in _RANGES.items()},
    "other": rf"(?:[^\p{{L}}\p{{N}}{_WHITE}\x{{3000}}-\x{{10ffff}}]|[{_REST}])",
}
CLOSING, OPENING = "、。，．」）』】〕〉》", "（「『【〔〈《"


def _class_rows(runs, chars) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{name}' AS class, CAST({runs(name)} AS BIGINT) AS n_runs, CAST({chars(name)} AS BIGINT) AS n_chars FROM d" for name in ["alnum", *CLASSES])


def _low(name: str) -> str:
    return "low" if name == "alnum" else "text"


@query(
    rf"WITH d AS (SELECT doc_id, text, regexp_replace(text, '[\x{{3000}}-\x{{10ffff}}]', chr(1), 'g') AS low FROM documents), r AS ("
    + _class_rows(lambda n: rf"len(regexp_extract_all({_low(n)}, '(?:{CLASSES.get(n, '[{a}]')})+'))".replace("{a}", r"\p{L}\p{N}"), lambda n: rf"length(text) - length(regexp_replace({_low(n)}, '{CLASSES.get(n, '[{a}]')}', '', 'g'))".replace("{a}", r"\p{L}\p{N}"))
    + ") SELECT * FROM r WHERE n_chars > 0"
)
def q18_char_classes(spark, sf_dir):
    """Runs and characters of each class in whole texts, without a row for each character: one pattern a class."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("low", F.regexp_replace("text", r"[\x{3000}-\x{10ffff}]", "\x01"))
    found = []
    for name in ["alnum", *CLASSES]:
        pattern, column = CLASSES.get(name, r"[\p{L}\p{N}]"), _low(name)
        n_runs = F.size(F.regexp_extract_all(column, F.lit(f"(?:{pattern})+"), 0)).cast("bigint")
        n_chars = (F.length("text") - F.length(F.regexp_replace(column, pattern, ""))).cast("bigint")
        found.append(F.struct(F.lit(name).alias("class"), n_runs.alias("n_runs"), n_chars.alias("n_chars")))
    return d.select("doc_id", F.explode(F.array(*found)).alias("c")).select("doc_id", "c.*").where("n_chars > 0")


@query(rf"""
SELECT doc_id, CAST(2 * length(text) - (length(text) - length(regexp_replace(text, '[\x20-\x7e\x{{ff61}}-\x{{ff9f}}\xa0-\x{{24f}}]', '', 'g'))) + 6 * (length(text) - length(replace(text, chr(9), ''))) AS BIGINT) AS half_cells,
  CAST(length(text) AS BIGINT) AS n_chars, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '[{CLOSING}]+[{OPENING}]?'), lambda m: length(m) - 1)), 0) AS BIGINT) AS squeezed FROM documents
""")
def q19_widths(spark, sf_dir):
    """Cells of whole texts, a tab taking eight half ones, and closing marks right before another mark, which take half a cell."""
    half = F.length("text") - F.length(F.regexp_replace("text", r"[\x20-\x7e\x{ff61}-\x{ff9f}\xa0-\x{24f}]", ""))
    tabs = F.length("text") - F.length(F.replace("text", F.lit("\t"), F.lit("")))
    marks = F.regexp_extract_all("text", F.lit(f"[{CLOSING}]+[{OPENING}]?"), 0)
    squeezed = F.aggregate(marks, F.lit(0).cast("bigint"), lambda n, m: n + F.length(m) - 1)
    return table(spark, sf_dir, "documents").select("doc_id", (2 * F.length("text") - half + 6 * tabs).cast("bigint").alias("half_cells"), F.length("text").cast("bigint").alias("n_chars"), squeezed.alias("squeezed"))


# Error words in the order in which they are looked for.
_KINDS = (("password", "password|encrypt|protect|暗号|パスワード"), ("too_large", "too large or damaged"), ("memory", "memory|allocation|out of bounds|unreachable"), ("unsupported", "unsupported|not supported|not a |format|signature|magic|対応"), ("damaged", "parse|corrupt|invalid|damaged|broken|truncat|壊れ"), ("read", "NotReadable|permission|NotAllowed|Security"))


def _kind(test) -> str:
    return "CASE " + " ".join(f"WHEN {test(words)} THEN '{kind}'" for kind, words in _KINDS) + " ELSE 'other' END"


_FAILURES = """SELECT bucket, ext, kind, count(*) AS n FROM (SELECT CASE WHEN mb < 1 THEN '<1MB' WHEN mb < 5 THEN '1-5MB' WHEN mb < 20 THEN '5-20MB' WHEN mb < 50 THEN '20-50MB' WHEN mb < 100 THEN '50-100MB' ELSE '>100MB' END AS bucket,
  coalesce(nullif(lower(regexp_extract(url, '[.]([A-Za-z0-9]+)$', 1)), ''), 'none') AS ext, {kind} AS kind FROM (SELECT url, html, CAST(length(html) AS DOUBLE) / 40 AS mb FROM {{pages}}) p) t GROUP BY bucket, ext, kind"""
sql_query(
    "q38_failure_codes",
    _FAILURES.format(kind=_kind(lambda w: f"html RLIKE '(?i){w}'")),
    _FAILURES.format(kind=_kind(lambda w: f"regexp_matches(html, '(?i){w}')")),
)
# Era dates of the orders, 25 years on.
_ERA = "concat('令和', CASE WHEN year(o_orderdate) + 25 - 2018 = 1 THEN '元' ELSE CAST(year(o_orderdate) + 25 - 2018 AS STRING) END, '年', CAST(month(o_orderdate) AS STRING), '月', CAST(day(o_orderdate) AS STRING), '日') AS era"
sql_query(
    "q39_filetime",
    f"""SELECT o_orderkey, ft, date_format(timestamp_micros(ft div 10 - 11644473600000000), 'yyyy-MM-dd HH:mm') AS stamp, {_ERA} FROM
    (SELECT o_orderkey, o_orderdate, (unix_micros(CAST(o_orderdate AS TIMESTAMP)) + 11644473600000000) * 10 AS ft FROM {{orders}}) t""",
    f"""SELECT o_orderkey, ft, strftime(make_timestamp(ft // 10 - 11644473600000000), '%Y-%m-%d %H:%M') AS stamp, {_ERA} FROM
    (SELECT o_orderkey, o_orderdate, (epoch_us(o_orderdate) + 11644473600000000) * 10 AS ft FROM {{orders}}) t""",
)
sql_query(
    "q40_style_decode",
    """SELECT p_partkey, on_flag, bold, size_pt, concat('#', lower(lpad(hex(raw & 255), 2, '0')), lower(lpad(hex(shiftright(raw, 8) & 255), 2, '0')), lower(lpad(hex(shiftright(raw, 16) & 255), 2, '0'))) AS color FROM
    (SELECT p_partkey, (raw & 4) <> 0 AS on_flag, (raw & 4) <> 0 AND (shiftright(raw, 3) & 3) IN (1, 2) AS bold, raw, CAST(least(999.0D, greatest(1.0D, round(p_size * 17.0D / 35.2778D * 2) / 2)) AS DOUBLE) AS size_pt FROM (SELECT p_partkey, p_size, (p_partkey * 7919) % 16777216 AS raw FROM {part}) s) t""",
    """SELECT p_partkey, on_flag, bold, size_pt, concat('#', printf('%02x', raw & 255), printf('%02x', (raw >> 8) & 255), printf('%02x', (raw >> 16) & 255)) AS color FROM
    (SELECT p_partkey, (raw & 4) <> 0 AS on_flag, (raw & 4) <> 0 AND ((raw >> 3) & 3) IN (1, 2) AS bold, raw, CAST(least(999.0, greatest(1.0, round(CAST(p_size AS DOUBLE) * 17.0 / 35.2778 * 2) / 2)) AS DOUBLE) AS size_pt FROM (SELECT p_partkey, p_size, (p_partkey * 7919) % 16777216 AS raw FROM {part}) s) t""",
)
# Line feeds in points by kind, of a normal feed of 18: none, parts of it, hundredths of a millimetre, thousandths of it.
_FEED = "CASE p_size % 10 WHEN 1 THEN 0.0D WHEN 2 THEN 9.0D WHEN 3 THEN 6.0D WHEN 4 THEN 4.5D WHEN 5 THEN 12.0D WHEN 6 THEN 13.5D WHEN 8 THEN CASE WHEN v > 0 THEN round(v * 72.0D / 2540.0D, 6) END WHEN 9 THEN CASE WHEN v > 0 THEN round(18.0D * v / 1000.0D, 6) END END"
_SHADE = "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 100 THEN CAST(255 - floor(((255 - v) * p_size + 50) / 100) AS BIGINT) END AS shade, {feed} AS feed_pt, round(v * {k}, 6) AS indent_pt FROM (SELECT p_partkey, p_size, p_partkey % 256 AS v FROM {{part}}) t"
_INDENT = "CASE WHEN p_size % 2 = 0 THEN 72.0D / 2540.0D ELSE 5.25D END"
sql_query("q41_shade", _SHADE.format(feed=_FEED, k=_INDENT), re.sub(r"(\d+\.\d+)D", r"CAST(\1 AS DOUBLE)", _SHADE.format(feed=_FEED, k=_INDENT)))


@query()
def q46_normalised(spark, sf_dir):
    """Visible characters in NFKC form: white space and box-drawing characters dropped; NFKC is in neither SQL engine."""
    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else "".join(unicodedata.normalize("NFKC", c) for c in t))

    bare = F.regexp_replace("text", "[\\s\\u3000\\u2500-\\u257F]", "")
    return table(spark, sf_dir, "documents").select("doc_id", nfkc(bare).alias("t")).select("doc_id", F.length("t").cast("bigint").alias("n_visible"), F.md5("t").alias("digest"))

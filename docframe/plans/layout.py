"""Folds of text into lines and pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from docframe.cluster import ship, spread
from docframe.functions.lines import CLOSING, HANGING, NOT_FIRST, NOT_LAST, OPENING, break_lines
from docframe.operators.sequences import top_n
from docframe.plans.registry import query, table

#: Half cells of a line, lines of a page.
WIDTH, PER_PAGE = 40, 40


def lines(docs):
    """doc_id, line_no, para_no, start, end of each line of the texts' paragraphs; line_no runs through the document."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found: tuple[list, ...] = ([], [], [], [], [])
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = 0
                for p, para in enumerate((t or "").split("\n")):
                    for a, b in break_lines(para, WIDTH):
                        for column, x in zip(found, (d, n, p, a, b)):
                            column.append(x)
                        n += 1
                if len(found[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=NAMES)
                    found = ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=NAMES)

    return spread(docs.select("doc_id", "text")).mapInArrow(run, ", ".join(f"{n} long" for n in NAMES))


NAMES = ["doc_id", "line_no", "para_no", "start", "end"]
#: The same in SQL, line by line: as many characters as fit, then the rules for marks.
_FIT = f"""greatest(1, list_max(list_filter(range(0, 41), lambda k: k <= length(s) AND 2 * k - (k - length(regexp_replace(s[1:k], '[\\x20-\\x7e\\x{{ff61}}-\\x{{ff9f}}\\xa0-\\x{{24f}}]', '', 'g'))) + 6 * (k - length(replace(s[1:k], chr(9), '')))
  - coalesce(list_sum(list_transform(regexp_extract_all(s[1:k + 1], '[{CLOSING}]+[{OPENING}]?'), lambda m: length(m) - 1)), 0) <= 40)))"""
_MOVED = f"CASE WHEN a + n >= length(t) THEN length(t) - a WHEN contains('{HANGING}', s[n + 1:n + 1]) THEN n + 1 WHEN contains('{NOT_FIRST}', s[n + 1:n + 1]) AND n > 1 THEN n - 1 ELSE n END"
_CUT = f"CASE WHEN a + n >= length(t) THEN length(t) ELSE a + greatest(1, length(rtrim(s[1:c], '{NOT_LAST}'))) END"


def _step(source: str) -> str:
    return f"SELECT doc_id, para_no, t, k, a, CAST({_CUT} AS BIGINT) AS b FROM (SELECT *, {_MOVED} AS c FROM (SELECT *, {_FIT} AS n FROM (SELECT *, substring(t, CAST(a + 1 AS BIGINT), 42) AS s FROM ({source}) x0) x1) x2) x3"


_SQL_LINES = f"""
WITH RECURSIVE p AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS para_no, unnest(string_split(text, chr(10))) AS t FROM documents),
c(doc_id, para_no, t, k, a, b) AS ({_step("SELECT doc_id, para_no, t, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS a FROM p")} UNION ALL {_step("SELECT doc_id, para_no, t, k + 1 AS k, b AS a FROM c WHERE b < length(t)")}),
l AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para_no, k) - 1 AS BIGINT) AS line_no, para_no, a, b FROM c)"""


@query(_SQL_LINES + """
SELECT doc_id, line_no, para_no, a AS start, b AS "end" FROM l""")
def q20_line_break(spark, sf_dir):
    return lines(table(spark, sf_dir, "documents"))


@query(_SQL_LINES + """
SELECT doc_id, CAST(line_no // 40 AS BIGINT) AS page, count(*) AS n_lines FROM l GROUP BY doc_id, line_no // 40""")
def q21_pagination(spark, sf_dir):
    return lines(table(spark, sf_dir, "documents")).groupBy("doc_id", F.expr(f"line_no div {PER_PAGE}").alias("page")).agg(F.count("*").alias("n_lines"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
SELECT doc_id, page, left(trim(line), 24) AS preview FROM (SELECT doc_id, CAST(i // 40 AS BIGINT) AS page, line, row_number() OVER (PARTITION BY doc_id, i // 40 ORDER BY i) AS n FROM l WHERE trim(line) <> '') WHERE n = 1
""")
def q22_previews(spark, sf_dir):
    l = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).where(F.trim("line") != "")  # noqa: E741
    first = top_n(l.withColumn("page", F.expr(f"cast(i as bigint) div {PER_PAGE}")), ["doc_id", "page"], ["i"], 1)
    return first.select("doc_id", "page", F.substring(F.trim("line"), 1, 24).alias("preview"))


@query("""
WITH s AS (SELECT doc_id, length(text) AS n, least(length(text), 150) AS pos, substring(text, 1, least(length(text), 150)) AS head FROM documents)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, CAST((length(head) - length(replace(head, chr(10), ''))) // 40 + 1 AS BIGINT) AS page, CAST(length(head) - length(replace(head, chr(10), '')) + 1 AS BIGINT) AS line,
  CAST(length(string_split(head, chr(10))[-1]) + 1 AS BIGINT) AS "column" FROM s
""")
def q23_status(spark, sf_dir):
    """Characters, page, line and column of the place 150 characters in."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), F.substring("text", 1, 150).alias("head"))
    d = d.withColumn("parts", F.split("head", "\n", -1))
    line = F.size("parts").cast("bigint")
    return d.select("doc_id", F.col("n").cast("bigint").alias("n_chars"), (F.expr("cast(size(parts) - 1 as bigint) div 40") + 1).alias("page"), line.alias("line"), (F.length(F.element_at("parts", -1)) + 1).cast("bigint").alias("column"))

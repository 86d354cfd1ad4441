"""Queries on the other formats: property sets, font tables, sheet names, embedded objects, packed documents, DOCX, RTF."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from docframe.cluster import ship, spread
from docframe.decode import archive, blocks, container, properties, texts
from docframe.limits import Limits
from docframe.plans import documents
from docframe.plans.decoded import doc_id
from docframe.plans.registry import query, table
from docframe.sources import exports, files


def _mapped(rows, schema: str, decode):
    """decode(row) -> list of tuples in the order of schema, for each row; the work stays in batches."""
    ship(rows.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        for batch in batches:
            found = [x for r in batch.to_pylist() for x in decode(r)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(arrow.types)], schema=arrow)

    return rows.mapInArrow(run, schema)


def _key():
    return F.regexp_extract("path", r"/(\d+)\.jtd$", 1).cast("bigint")


def _suppliers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("/"), "s_suppkey", F.lit(".jtd")).alias("path"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))


@query("""
SELECT s_suppkey, concat('/', CASE k WHEN 0 THEN 'Embedding ' || s_nationkey WHEN 1 THEN 'OLEItem' ELSE 'FigureData' END) AS object FROM supplier, range(3) r(k) WHERE s_nationkey % (k + 2) = 0
""")
def d16_embedded_objects(spark, sf_dir):
    """Storages that hold embedded objects, by their names whatever the case, at the top of each file."""

    def content(r):
        names = [n for k, n in enumerate((f"Embedding {r['nation']}", "OLEItem", "FigureData")) if r["nation"] % (k + 2) == 0]
        return container.write_container({"/DocumentText": blocks.text_store("x"), "/Other/figuredata.txt": b"1", "/Notes/a": b"2", **{f"/{n}/data": b"3" for n in names}})

    written = _mapped(_suppliers(spark, sf_dir), "path string, content binary", lambda r: [(r["path"], content(r))])
    e = files.entries(written).where("kind = 'storage'")
    low = F.lower("name")
    return e.where(low.startswith("embedding") | low.startswith("oleitem") | (low == "figuredata")).select(_key().alias("s_suppkey"), F.col("entry_path").alias("object"))


@query("""
SELECT s_suppkey, s_name AS title, concat('n', s_nationkey) AS author, CAST(s_nationkey AS INTEGER) AS pages, strftime(make_timestamp((133000000000000000 + s_suppkey * 600000000) // 10 - 11644473600000000), '%Y-%m-%d %H:%M') AS created FROM supplier
""")
def d17_summary(spark, sf_dir):
    """The property set of each file, written and read."""

    def content(r):
        values = {2: r["name"], 4: f"n{r['nation']}", 14: r["nation"], 12: 133_000_000_000_000_000 + r["key"] * 600_000_000}
        return container.write_container({"/DocumentText": blocks.text_store("x"), "/\x05SummaryInformation": properties.summary_bytes(values)})

    written = _mapped(_suppliers(spark, sf_dir), "path string, content binary", lambda r: [(r["path"], content(r))])
    return files.summaries(written).select(_key().alias("s_suppkey"), "title", "author", "pages", "created")


@query("""
SELECT s_suppkey, CAST(k AS BIGINT) AS font, concat('Face ', s_nationkey, '-', k) AS name, CAST((s_nationkey * 3 + k) % 256 AS INTEGER) AS charset FROM supplier, range(7) r(k) WHERE k < 1 + s_nationkey % 7
""")
def d18_fonts(spark, sf_dir):
    """The font table of each file as rows."""

    def rows(r):
        own = [(f"Face {r['nation']}-{k}", (r["nation"] * 3 + k) % 256) for k in range(1 + r["nation"] % 7)]
        return [(r["key"], k, *f) for k, f in enumerate(properties.fonts(properties.fonts_bytes(own)))]

    return _mapped(_suppliers(spark, sf_dir), "s_suppkey long, font long, name string, charset int", rows)


@query("""
SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY k) - 1 AS BIGINT) AS place, CASE k WHEN 1 THEN s_name ELSE concat('Sheet of ', s_nationkey) END AS name FROM supplier, range(5) r(k) WHERE k IN (1, 4)
""")
def d19_sheet_names(spark, sf_dir):
    """Names of sheets in a stream of words; storage names, paths and overlong texts are none."""

    def rows(r):
        words = "\0".join(["DOCS_1", r["name"], "c:\\x", "y" * 70, f"Sheet of {r['nation']}"]) + "\0"
        return [(r["key"], k, n) for k, n in enumerate(properties.sheet_names(words.encode("utf-16-le")))]

    return _mapped(_suppliers(spark, sf_dir), "s_suppkey long, place long, name string", rows)


@query("""
SELECT s_suppkey, path, md5(body) AS digest FROM (SELECT s_suppkey, '/A' AS path, concat('new ', s_name) AS body FROM supplier UNION ALL SELECT s_suppkey, '/Keep/B', CAST(s_nationkey AS VARCHAR) FROM supplier UNION ALL SELECT s_suppkey, '/New/D', 'd' FROM supplier)
""")
def d20_stream_edits(spark, sf_dir):
    """Streams after one was replaced, one added and a storage removed, read by their paths."""

    def rows(r):
        data = container.write_container({"/A": b"old", "/Keep/B": str(r["nation"]).encode(), "/Gone/C": b"c" * 5000, "/Gone/E/F": b"f"})
        c = container.open_container(container.edited(data, {"/A": f"new {r['name']}".encode(), "/New/D": b"d"}, {"/Gone"}))
        return [(r["key"], p, hashlib.md5(content).hexdigest()) for p, content in container.streams_of(c).items()]

    return _mapped(_suppliers(spark, sf_dir), "s_suppkey long, path string, digest string", rows)


@query("""
SELECT doc_id, md5(concat(text, chr(10))) AS digest, CAST(length(text) + 1 AS BIGINT) AS n_chars FROM documents
""")
def d21_docx(spark, sf_dir):
    """Texts as DOCX files, and the characters read back from them."""

    def rows(r):
        found = "".join(c for c, _ in texts.docx_characters(texts.docx([(line, False) for line in (r["text"] or "").split("\n")])))
        return [(r["doc_id"], hashlib.md5(found.encode()).hexdigest(), len(found))]

    return _mapped(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id long, digest string, n_chars long", rows)


@query(r"""
SELECT doc_id, md5(trim(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), E' \n\t\r')) AS digest FROM documents
""")
def d22_rtf(spark, sf_dir):
    """Texts as RTF files, and what is shown of them."""
    return _mapped(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id long, digest string", lambda r: [(r["doc_id"], hashlib.md5(texts.rtf_text(texts.rtf(r["text"] or "")).encode()).hexdigest())])


@query("SELECT s_suppkey, concat('漢字と', s_name) AS text FROM supplier")
def d23_text_decoding(spark, sf_dir):
    """Text files in one of two encodings, by the first that fits."""
    return _mapped(_suppliers(spark, sf_dir), "s_suppkey long, text string", lambda r: [(r["key"], texts.plain_text(f"漢字と{r['name']}".encode("utf-8" if r["key"] % 2 else "cp932")))])


@query(r"""
SELECT s_suppkey, concat(s_name, chr(10), 'key', chr(9), s_suppkey, chr(10), 'nation', chr(9), s_nationkey, chr(10), chr(12), 'see ', s_nationkey, chr(10)) AS body FROM supplier
""")
def d24_packed_documents(spark, sf_dir):
    """Documents inside archives inside containers."""

    def packed(r):
        return [(r["path"], container.write_container({"/JSCompDocument": archive.stored_member("a.jtd", r["content"])}))]

    return exports.document_text(files.tree(_mapped(documents._files(spark, sf_dir), "path string, content binary", packed))).select(_key().alias("s_suppkey"), "body")


@query("SELECT doc_id, CASE WHEN length(text) > 1000 THEN 'TooLarge' END AS error_class, CASE WHEN length(text) <= 1000 THEN CAST(length(text) AS BIGINT) END AS n_chars FROM documents")
def d25_text_limit(spark, sf_dir):
    """Documents above a limit become error rows, the others are read."""
    t = files.tokens(files.containers(table(spark, sf_dir, "documents")), Limits(max_text_units=1000))
    # A control character is a token without text.
    size = F.when(F.col("kind") == "control", 1).otherwise(F.length("text"))
    return t.groupBy(doc_id()).agg(F.max("error_class").alias("error_class"), F.sum(size).cast("bigint").alias("n_chars"))


@query("""
SELECT kind, count(*) AS n, CAST(sum(n_units) AS BIGINT) AS n_units FROM (SELECT doc_id, CASE WHEN run = chr(10) THEN 'control' ELSE 'text' END AS kind, length(run) AS n_units FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\n|[^\\n]+')) AS run FROM documents)) GROUP BY kind
""")
def d26_token_report(spark, sf_dir):
    """The token report over all files: kinds with their counts."""
    t = files.tokens(files.containers(table(spark, sf_dir, "documents")))
    return t.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.when(F.col("kind") == "control", 1).otherwise(F.length("text"))).cast("bigint").alias("n_units"))

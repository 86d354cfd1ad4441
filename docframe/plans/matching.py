"""Queries that match collections: lookups, semi and anti joins, bands, nearest, recursion, pairs."""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Window, functions as F

from docframe.cluster import ship
from docframe.functions.edits import common_ends, difference, greedy_bands, replace_all
from docframe.operators import sequences as S
from docframe.plans.registry import query, sql_query, table


@query("""SELECT p_partkey, arg_min(s_suppkey, d * 1000000 + s_suppkey) AS nearest, min(d) AS distance FROM (SELECT p_partkey, s_suppkey, abs(p_size * 100 - CAST(floor(s_acctbal) AS BIGINT)) AS d FROM part JOIN supplier ON s_nationkey = p_partkey % 25) t GROUP BY p_partkey""")
def q24_nearest(spark, sf_dir):
    """The supplier nearest to each part's place among those of a nation, by two lookups in order instead of all pairs."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 25).alias("k"), (F.col("p_size") * 100).cast("bigint").alias("at"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("bigint").alias("k"), F.floor("s_acctbal").cast("bigint").alias("at"), F.col("s_suppkey").alias("no"))
    return S.nearest(p, s, "k", "at", "no", "nearest", "distance", lambda at: F.floor(at / 1000)).where("nearest is not null").select("p_partkey", "nearest", "distance")


@query("""
WITH p AS (SELECT p_partkey, p_brand, CAST(floor(p_retailprice) AS BIGINT) AS v FROM part)
SELECT a.p_partkey, CAST(count(*) AS BIGINT) AS n_in_band, min(b.p_partkey) AS first_match FROM p a JOIN p b ON a.p_brand = b.p_brand AND abs(a.v - b.v) <= greatest(20, a.v // 50) GROUP BY a.p_partkey
""")
def q26_band_match(spark, sf_dir):
    """Values within a tolerance that grows with the value: counted by distinct value, without a row for each pair."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.floor("p_retailprice").cast("bigint").alias("v"))
    reach = F.greatest(F.lit(20), F.expr("v div 50"))
    bands = S.in_range(p, ["p_brand"], "v", F.col("v") - reach, F.col("v") + reach, "p_partkey", "n", "first")
    return p.join(bands.hint("merge"), ["p_brand", "v"]).groupBy("p_partkey").agg(F.sum("n").alias("n_in_band"), F.min("first").alias("first_match"))


@query("""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
SELECT c_custkey, o_orderkey AS first_order, c_mktsegment FROM customer JOIN o ON c_custkey = o_custkey AND n = 1
""")
def q27_first_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("first_order"), "o_orderdate")
    return S.first_match(table(spark, sf_dir, "customer"), o, "c_custkey", ["o_orderdate", "first_order"]).select("c_custkey", "first_order", "c_mktsegment")


@query("""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS position FROM supplier),
c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS position FROM customer)
SELECT s_nationkey AS nation, CAST(s.position AS BIGINT) AS position, s_suppkey, c_custkey FROM s JOIN c ON s_nationkey = c_nationkey AND s.position = c.position
""")
def q27_positional_zip(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    return S.zipped(s, c, ["nation"], ["s_suppkey"], ["c_custkey"]).select("nation", F.col("position").cast("bigint").alias("position"), "s_suppkey", "c_custkey")


sql_query(
    "q28_semi_anti_outer",
    """SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 300000) THEN 'large' ELSE 'none' END AS has_large, coalesce(nick, concat('Customer ', CAST(c_custkey AS STRING))) AS title
    FROM {customer} LEFT JOIN (SELECT s_suppkey, s_name AS nick FROM {supplier}) s ON s_suppkey = c_custkey
    WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""",
)
sql_query("q28_top_n", "SELECT c_custkey, c_name FROM {customer} ORDER BY c_name, c_custkey LIMIT 10")
sql_query(
    "q30_recursive_walk",
    """WITH RECURSIVE w(k, name, depth, path) AS (
      SELECT CAST(n_nationkey AS BIGINT), n_name, 0, CAST(n_name AS STRING) FROM {nation} WHERE n_nationkey = 0
      UNION ALL SELECT CAST(n_nationkey AS BIGINT), n_name, depth + 1, concat(path, '/', n_name) FROM {nation} JOIN w ON n_nationkey > 0 AND (n_nationkey - 1) div 2 = k)
    SELECT k, name, CAST(depth AS BIGINT) AS depth, path FROM w""",
    """WITH RECURSIVE w(k, name, depth, path) AS (
      SELECT CAST(n_nationkey AS BIGINT), n_name, 0, CAST(n_name AS VARCHAR) FROM {nation} WHERE n_nationkey = 0
      UNION ALL SELECT CAST(n_nationkey AS BIGINT), n_name, depth + 1, concat(path, '/', n_name) FROM {nation} JOIN w ON n_nationkey > 0 AND (n_nationkey - 1) // 2 = k)
    SELECT k, name, CAST(depth AS BIGINT) AS depth, path FROM w""",
)
sql_query(
    "q37_unpivot_anti",
    """SELECT DISTINCT url FROM (SELECT url FROM {pages} UNION ALL SELECT concat(url, '.pair') FROM {pages} WHERE page_id % 3 = 0) u WHERE url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {pages} p WHERE p.url = u.url AND p.page_id % 2 = 0)""",
)
sql_query(
    "q43_pages_headers",
    """SELECT r_regionkey AS place, n_nationkey AS page, replace(concat(r_name, ' ?'), '?', CAST(n_nationkey + 1 AS STRING)) AS header FROM {region} JOIN {nation} ON (r_regionkey NOT IN (2, 3)) OR (r_regionkey = 2 AND n_nationkey % 2 = 0) OR (r_regionkey = 3 AND n_nationkey % 2 = 1)""",
)


@query("""
WITH b AS (SELECT item_id, text AS b, row_number() OVER (ORDER BY item_id) - 1 AS place, count(*) OVER () AS n_items FROM benchmark),
p AS (SELECT doc_id, item_id, d.text AS a, b FROM documents d JOIN b ON doc_id % n_items = place),
n AS (SELECT *, coalesce(list_max(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[1:i] = b[1:i])), 0) AS pre FROM p)
SELECT doc_id, item_id, CAST(pre AS BIGINT) AS prefix, CAST(coalesce(list_max(list_filter(range(1, least(length(a), length(b)) - pre + 1), lambda i: right(a, i) = right(b, i))), 0) AS BIGINT) AS suffix FROM n
""")
def q45_prefix_suffix(spark, sf_dir):
    """Common prefix and suffix of whole texts, the trim before a difference: each document with an item, all items in turn."""
    ship(spark)
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("b"))
    b = b.withColumn("place", F.row_number().over(Window.orderBy("item_id")) - 1)
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("a")).withColumn("place", F.col("doc_id") % F.lit(b.count()))

    def run(batches):
        for batch in batches:
            ends = [common_ends(x or "", y or "") for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1))], names=["doc_id", "item_id", "prefix", "suffix"])

    return d.join(b, "place").select("doc_id", "item_id", "a", "b").mapInArrow(run, "doc_id long, item_id long, prefix long, suffix long")


@query("""
WITH old AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark) GROUP BY word), new AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word)
SELECT unnest(['deleted', 'inserted']) AS op, unnest([d, i]) AS n FROM (SELECT CAST(sum(greatest(coalesce(old.n, 0) - coalesce(new.n, 0), 0)) AS BIGINT) AS d, CAST(sum(greatest(coalesce(new.n, 0) - coalesce(old.n, 0), 0)) AS BIGINT) AS i FROM old FULL JOIN new USING (word))
""")
def q45_multiset_difference(spark, sf_dir):
    """Words to delete from and to insert into the benchmark's to get the documents', by the counts of each word."""
    words = lambda name, n: table(spark, sf_dir, name).select(F.explode(F.split("text", " ", -1)).alias("word")).groupBy("word").agg(F.count("*").alias(n))
    both = words("benchmark", "old").join(words("documents", "new"), "word", "full")
    less = lambda a, b: F.sum(F.greatest(F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)), F.lit(0)))
    sums = both.agg(less("old", "new").alias("deleted"), less("new", "old").alias("inserted"))
    return sums.unpivot([], ["deleted", "inserted"], "op", "n")


@query("""
WITH q AS (SELECT doc_id, text, string_split(text, 'the') AS parts FROM documents)
SELECT doc_id, CAST(length(array_to_string(parts[1:i], 'the')) AS BIGINT) AS at FROM (SELECT doc_id, parts, unnest(range(1, len(parts))) AS i FROM q)
""")
def q85_find_all(spark, sf_dir):
    """Every place of a word in every text, from the left without overlap."""
    parts = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "the", -1).alias("parts"))
    sizes = F.transform("parts", lambda p: F.length(p) + 3)
    at = F.aggregate(F.slice(sizes, F.lit(1), F.size("parts") - 1), F.array(F.lit(0)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))
    return parts.select("doc_id", F.explode(F.slice(at, F.lit(2), F.size("parts") - 1)).alias("end")).select("doc_id", (F.col("end") - 3).cast("bigint").alias("at"))


@query("""
SELECT doc_id, md5(CASE WHEN contains(text, 'and') THEN concat(text[1:position('and' IN text) - 1], '&and', text[position('and' IN text) + 3:]) ELSE text END) AS once, CAST(contains(text, 'and') AS BIGINT) AS n_once,
  md5(regexp_replace(text, ' +', ' ', 'g')) AS squeezed FROM documents
""")
def q86_replace_rescanning(spark, sf_dir):
    """Replacements that are searched for from the start again; one only if what is put holds what is looked for."""
    ship(spark)

    def run(batches):
        for batch in batches:
            once, twice = ([replace_all(t or "", *pair) for t in batch.column(1).to_pylist()] for pair in (("and", "&and"), ("  ", " ")))
            digest = lambda found: pa.array([hashlib.md5(t.encode()).hexdigest() for t, _ in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), digest(once), pa.array([n for _, n in once], pa.int64()), digest(twice)], names=["doc_id", "once", "n_once", "squeezed"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, once string, n_once long, squeezed string")


@query()
def q87_edit_script(spark, sf_dir):
    """Each conversation's turns against those before them: words kept, deleted and inserted, as the shortest script."""
    ship(spark)
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    pairs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lag("text").over(w).alias("before")).where("before is not null")

    def run(batches):
        for batch in batches:
            scripts = [difference((a or "").split(" "), (b or "").split(" ")) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            count = lambda op: pa.array([sum(n for o, _, n in s if o == op) for s in scripts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), count("keep"), count("delete"), count("insert")], names=["conv_id", "turn", "kept", "deleted", "inserted"])

    return pairs.select("conv_id", "turn", "before", "text").mapInArrow(run, "conv_id long, turn long, kept long, deleted long, inserted long")


@query()
def q88_greedy_bands(spark, sf_dir):
    """Frames of an order (its lines of odd number) each with one figure (of even number) of about its size, in two passes."""
    ship(spark)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.floor("l_extendedprice").cast("bigint").alias("size"))
    rows = rows.repartition("l_orderkey").sortWithinPartitions("l_orderkey", "l_linenumber", "l_partkey", "size")

    def run(batches):
        lines = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple] = []
        for order, group in groupby(lines, key=lambda r: r[0]):
            group = list(group)
            frames, figures = [r for r in group if r[1] % 2], [r for r in group if r[1] % 2 == 0]
            found = greedy_bands([r[3] for r in frames], [r[3] for r in figures])
            out += [(order, f[2], None if k is None else figures[k][2]) for f, k in zip(frames, found)]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["l_orderkey", "frame", "figure"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["l_orderkey", "frame", "figure"])

    return rows.mapInArrow(run, "l_orderkey long, frame long, figure long")

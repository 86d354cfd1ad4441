"""Queries on ordered rows: spans, carried state, offsets, edges, gaps."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from docframe.operators import sequences as S
from docframe.plans.registry import query, sql_query, table

LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_LINE = ", ".join(LINE)


@query("""
WITH a AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new, row_number() OVER w - 1 AS pos
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM a)
SELECT user_id, CAST(n AS BIGINT) AS span_no, event_type, CAST(min(pos) AS BIGINT) AS start, CAST(count(*) AS BIGINT) AS length FROM b GROUP BY user_id, n, event_type
""")
def q05_event_spans(spark, sf_dir):
    return S.spans(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type IN ('purchase', 'click') THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS state FROM events
""")
def q06_persistent_state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_type").isin("purchase", "click"), F.col("value"))
    return S.carried(e, ["user_id"], ["ts", "event_id"], value, "state").select("event_id", "user_id", "state")


@query("""
WITH e AS (SELECT event_id, user_id % 97 AS k, CAST(ts AS DATE) + INTERVAL (-(CAST(year(ts) AS INTEGER) - 1995)) YEAR AS t FROM events),
o AS (SELECT o_custkey % 97 AS k, CAST(o_orderdate AS TIMESTAMP) AS t, max(o_orderkey) AS o FROM orders GROUP BY 1, 2)
SELECT e.event_id, CAST(e.k AS BIGINT) AS k, o.o AS order_key FROM e ASOF LEFT JOIN o ON e.k = o.k AND e.t >= o.t
""")
def q07_as_of(spark, sf_dir):
    """The order in effect at an event's day, by hashed key."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 97).alias("k"), F.expr("cast(cast(ts as date) + make_ym_interval(1995 - year(ts), 0) as timestamp_ntz)").alias("t"))
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).alias("k"), F.col("o_orderdate").cast("timestamp_ntz").alias("t"), F.col("o_orderkey").alias("o"))
    return S.as_of(e, o, "k", "t", "o", "order_key", lambda t: F.year(t) * 12 + F.month(t)).select("event_id", "k", "order_key")


@query("""
SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_before,
  count(*) OVER (PARTITION BY conv_id, turn) > 1 AS repeated FROM conversations
""")
def q08_offsets(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    out = S.running(c, ["conv_id"], ["turn", "role", "text"], F.length("text"), "offset_before")
    return out.select("conv_id", "turn", F.col("offset_before").cast("bigint").alias("offset_before"), (F.count("*").over(Window.partitionBy("conv_id", "turn")) > 1).alias("repeated"))


sql_query(
    "q09_row_join",
    "SELECT l_orderkey, concat_ws(chr(9), transform(array_sort(collect_list(struct(l_linenumber, l_partkey, l_suppkey))), x -> cast(x.l_partkey AS string))) AS body FROM {lineitem} GROUP BY l_orderkey",
    "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), chr(9) ORDER BY l_linenumber, l_partkey, l_suppkey) AS body FROM {lineitem} GROUP BY l_orderkey",
)
sql_query(
    "q10_edges",
    "SELECT l_orderkey, array_join(array_sort(collect_set(datediff(l_shipdate, timestamp '1992-01-01'))), ',') AS edges FROM {lineitem} GROUP BY l_orderkey",
    "SELECT l_orderkey, string_agg(CAST(d AS VARCHAR), ',' ORDER BY d) AS edges FROM (SELECT DISTINCT l_orderkey, datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS d FROM {lineitem}) GROUP BY l_orderkey",
)


@query(f"""
WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity, sum(l_quantity + l_linenumber + 2) OVER (PARTITION BY l_orderkey ORDER BY {_LINE} ROWS UNBOUNDED PRECEDING) - 1 AS centre FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(centre AS BIGINT) AS centre, CAST(max(centre) OVER (PARTITION BY l_orderkey) AS BIGINT) AS row_end,
  max(centre) OVER (PARTITION BY l_orderkey) = sum(l_quantity + l_linenumber + 2) OVER (PARTITION BY l_orderkey) - 1 AS adds_up FROM c
""")
def q11_rule_geometry(spark, sf_dir):
    step = F.col("l_quantity") + F.col("l_linenumber") + 2
    out = S.running(table(spark, sf_dir, "lineitem"), ["l_orderkey"], LINE, step, "total", with_current=True).withColumn("centre", F.col("total") - 1)
    w = Window.partitionBy("l_orderkey")
    return out.select("l_orderkey", "l_linenumber", F.col("centre").cast("bigint").alias("centre"), F.max("centre").over(w).cast("bigint").alias("row_end"), (F.max("centre").over(w) == F.sum(step).over(w) - 1).alias("adds_up"))


sql_query(
    "q12_edge_rank",
    """WITH e AS (SELECT DISTINCT l_orderkey, l_partkey AS edge FROM {lineitem}),
    r AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY edge) AS n, lead(edge) OVER (PARTITION BY l_orderkey ORDER BY edge) - edge AS width, max(edge) OVER (PARTITION BY l_orderkey) - min(edge) OVER (PARTITION BY l_orderkey) AS total FROM e)
    SELECT l_orderkey, edge, CAST(n AS BIGINT) AS rank, width, CASE WHEN total > 0 THEN round(100.0 * CAST(width AS DOUBLE) / CAST(total AS DOUBLE), 2) END AS percent FROM r""",
)
sql_query(
    "q13_snapping",
    """SELECT l_orderkey, l_partkey, coalesce(lead(l_partkey) OVER w, greatest(l_suppkey, l_partkey + 1)) AS right_edge FROM
    (SELECT l_orderkey, l_partkey, max(l_suppkey) AS l_suppkey FROM {lineitem} GROUP BY l_orderkey, l_partkey) t WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_partkey)""",
)


@query("""
WITH i AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS a, CAST(floor(value) AS BIGINT) + 3 AS b FROM events),
g AS (SELECT user_id, greatest(0, coalesce(max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS gap_start, least(a, 500) AS gap_end FROM i
  UNION ALL SELECT user_id, greatest(0, max(b)), 500 FROM i GROUP BY user_id)
SELECT user_id, CAST(count(*) AS BIGINT) AS n_gaps, CAST(max(gap_end - gap_start) AS BIGINT) AS widest, CAST(min(gap_start) AS BIGINT) AS first_gap FROM g WHERE gap_end > gap_start GROUP BY user_id
""")
def q25_free_spans(spark, sf_dir):
    a = F.floor("value").cast("bigint")
    i = table(spark, sf_dir, "events").select("user_id", a.alias("a"), (a + 3).alias("b"))
    g = S.gaps(i, ["user_id"], "a", "b", F.lit(0).cast("bigint"), F.lit(500).cast("bigint"))
    return g.groupBy("user_id").agg(F.count("*").alias("n_gaps"), F.max(F.col("gap_end") - F.col("gap_start")).alias("widest"), F.min("gap_start").alias("first_gap"))


sql_query(
    "q44_z_order",
    "SELECT l_orderkey, l_linenumber, l_partkey, CAST(coalesce(array_position(array(3L, 1L, 4L, 15L, 9L, 2L, 6L), l_suppkey), 0) AS BIGINT) AS z FROM {lineitem}",
    "SELECT l_orderkey, l_linenumber, l_partkey, CAST(coalesce(list_position([3, 1, 4, 15, 9, 2, 6], l_suppkey), 0) AS BIGINT) AS z FROM {lineitem}",
)


@query("""
WITH a AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM a),
c AS (SELECT user_id, CAST(n AS BIGINT) AS step, min(event_type) AS kind, CAST(count(*) AS BIGINT) AS edits FROM b GROUP BY user_id, n)
SELECT user_id, step, kind, edits FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step DESC) AS r FROM c) WHERE r <= 100
""")
def q47_undo_steps(spark, sf_dir):
    """Edits of one kind in a row are one step; the latest 100 steps stay."""
    steps = S.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", "step").groupBy("user_id", "step").agg(F.min("event_type").alias("kind"), F.count("*").alias("edits"))
    return S.top_n(steps, ["user_id"], [F.desc("step")], 100).drop("rank")


@query("""
WITH r AS (SELECT doc_id, source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents)
SELECT doc_id, source, CAST(used AS BIGINT) AS used, n_chars > 5000 AS large FROM r WHERE used <= 20000
""")
def q42_budget(spark, sf_dir):
    """A running budget that stops at the first overflow."""
    kept = S.within_budget(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], F.col("n_chars"), F.lit(20000), F.expr("doc_id div 1000"))
    return kept.select("doc_id", "source", F.col("used").cast("bigint").alias("used"), (F.col("n_chars") > 5000).alias("large"))

"""Corpus metrics: histograms, extremes, recall, similarity, predictive gain."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F

from docframe.operators.sequences import top_n
from docframe.plans.registry import query, sql_query, table

sql_query(
    "q29_path_histogram",
    "SELECT p AS path, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS n_chars, min_by(url, page_id) AS example FROM (SELECT *, regexp_replace(url, '[0-9]', '#') AS p FROM {pages}) t GROUP BY p",
    "SELECT p AS path, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS n_chars, arg_min(url, page_id) AS example FROM (SELECT *, regexp_replace(url, '[0-9]', '#', 'g') AS p FROM {pages}) t GROUP BY p",
)
sql_query(
    "q31_class_histogram",
    """SELECT event_type, count(*) AS n, round(max(value), 6) AS most, max_by(event_id, struct(value, -event_id)) AS at, array_join(array_sort(collect_set(user_id % 7)), ',') AS kinds, CAST(count_if(value > 50) AS BIGINT) AS large FROM {events} GROUP BY event_type""",
    """SELECT event_type, count(*) AS n, round(max(value), 6) AS most, (list(event_id ORDER BY value DESC, event_id))[1] AS at, array_to_string(list_sort(list(DISTINCT user_id % 7)), ',') AS kinds, CAST(count_if(value > 50) AS BIGINT) AS large FROM {events} GROUP BY event_type""",
)
sql_query(
    "q32_failures_per_key",
    """SELECT o_orderpriority, count(*) AS total, CAST(count_if(n IS NOT NULL) AS BIGINT) AS ok, CAST(count_if(n IS NULL) AS BIGINT) AS refused, min(CASE WHEN n IS NULL THEN o_orderkey END) AS example, CAST(count_if(n IS NOT NULL) AS DOUBLE) / count(*) >= 0.85D AS good
    FROM {orders} LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) l ON o_orderkey = l_orderkey GROUP BY o_orderpriority""",
    """SELECT o_orderpriority, count(*) AS total, CAST(count_if(n IS NOT NULL) AS BIGINT) AS ok, CAST(count_if(n IS NULL) AS BIGINT) AS refused, min(CASE WHEN n IS NULL THEN o_orderkey END) AS example, CAST(count_if(n IS NOT NULL) AS DOUBLE) / count(*) >= 0.85 AS good
    FROM {orders} LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) l ON o_orderkey = l_orderkey GROUP BY o_orderpriority""",
)
sql_query(
    "q33_weighted_recall",
    """SELECT lang, CAST(sum(quality * n_chars) AS BIGINT) AS hit, CAST(sum(n_chars) AS BIGINT) AS total, round(CAST(sum(quality * n_chars) AS DOUBLE) / greatest(1, sum(n_chars)), 6) AS recall FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id GROUP BY lang""",
)
sql_query(
    "q33_worst_ten",
    """SELECT source, round(CAST(sum(quality * n_chars) AS DOUBLE) / greatest(1, sum(n_chars)), 6) AS recall FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id GROUP BY source ORDER BY recall, source LIMIT 10""",
)
sql_query(
    "q34_similarity",
    """SELECT source, round(sum(CAST(coalesce(quality, 0) AS DOUBLE) * n_chars) / greatest(sum(n_chars), 1), 6) AS mean_ratio, CAST(count_if(quality = 1) AS BIGINT) AS exact, count(*) AS n FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id GROUP BY source""",
)
sql_query(
    "q35_predictive_gain",
    """WITH c AS (SELECT o_orderpriority AS v, c_mktsegment AS val, count(*) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT CAST(sum(m) AS BIGINT) AS by_value, (SELECT CAST(max(s) AS BIGINT) FROM (SELECT sum(n) AS s FROM c GROUP BY val) g) AS overall, round(CAST(sum(m) - (SELECT max(s) FROM (SELECT sum(n) AS s FROM c GROUP BY val) g) AS DOUBLE) / CAST(sum(t) AS DOUBLE), 9) AS gain
    FROM (SELECT v, max(n) AS m, sum(n) AS t FROM c GROUP BY v) x""",
)


@query("""
WITH c AS (SELECT o_orderpriority AS v, c_mktsegment AS val, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT v, val, n, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY n DESC, val) AS r FROM c) WHERE r <= 4
""")
def q35_top_four(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cells = joined.groupBy(F.col("o_orderpriority").alias("v"), F.col("c_mktsegment").alias("val")).agg(F.count("*").alias("n"))
    return top_n(cells, ["v"], [F.desc("n"), F.col("val")], 4)


@query()
def q36_alignment(spark, sf_dir):
    """Matched characters of each benchmark item and the document with its number, spaces ignored."""
    @F.pandas_udf("long")
    def matched(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            return sum(m.size for m in difflib.SequenceMatcher(None, "".join(x.split()), "".join(y.split()), autojunk=False).get_matching_blocks())

        return pd.Series([one(x, y) for x, y in zip(a, b)])

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("a"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("b"))
    return b.join(d, "item_id").repartition("item_id").select("item_id", F.length("b").cast("bigint").alias("n_chars"), matched("a", "b").alias("n_matched"))

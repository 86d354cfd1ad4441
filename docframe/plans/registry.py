"""Registration of catalogue queries: a function or an SQL text for Spark, and the SQL that gives the same rows."""

from __future__ import annotations

import re

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function as a query, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """Register an SQL text with tables written {name}; the other engine runs it, or `oracle`, over the same tables."""

    def run(spark, sf_dir):
        used = set(re.findall(r"\{(\w+)\}", text))
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = re.sub(r"\{(\w+)\}", r"\1", oracle or text)

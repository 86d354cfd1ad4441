"""Every query of the core catalogue against the other engine, on the smallest tables."""

import pytest

from docframe.plans.catalogue import ORACLE_SQL, QUERIES
from tests.conftest import SMALL, rows_of


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equal(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = rows_of(df.columns, df.collect())
    cursor = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows_of(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_alignment_of_equal_texts(spark, tmp_path):
    one = spark.createDataFrame([(1, "a bc d")], "doc_id long, text string")
    one.write.parquet(f"{tmp_path}/documents.parquet")
    one.withColumnRenamed("doc_id", "item_id").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert QUERIES["q36_alignment"](spark, str(tmp_path)).first()["n_matched"] == 4


def rows_made(plan):
    """The largest count of rows that a node of an executed plan gave."""
    kind = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(k) for k in range(plan.children().size())]
    made = plan.metrics().get("numOutputRows")
    return max([made.get().value() if made.isDefined() else 0, *map(rows_made, below)])


def test_band_match_of_equal_values(spark, tmp_path):
    spark.range(2000).selectExpr("id AS p_partkey", "'b' AS p_brand", "900D + id % 2 AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["q26_band_match"](spark, str(tmp_path))
    assert {(r["n_in_band"], r["first_match"]) for r in df.collect()} == {(2000, 0)}
    assert 2000 <= rows_made(df._jdf.queryExecution().executedPlan()) <= 4000


def test_band_match_of_odd_values(spark, tmp_path):
    import duckdb

    prices = [None, -1e15, -30.5, -0.5, 0.0, 0.5, 20.0, 999.9, 1020.0, 1020.5, 1050.0, 1071.0, 1e9, 1.02e9, 1.0201e9, 1e15, 1.02e15, 1.03e15]
    rows = [(None if k % 7 == 3 else k // 2, "b" if k % 5 else None, price) for k, price in enumerate(prices * 3)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["q26_band_match"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    cursor = con.execute(ORACLE_SQL["q26_band_match"])
    columns = [c[0] for c in cursor.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_import_without_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=root, check=True)

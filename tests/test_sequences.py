"""Operators over ordered rows: nulls, ties, empty tables."""

import random

from pyspark.sql import functions as F

from docframe.operators import sequences as S


def test_spans_with_nulls(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "a"), (1, 4, "a"), (1, 5, None), (2, 1, "a")], "k int, t int, v string")
    got = sorted((r["k"], r["span_no"], r["v"] or "", r["start"], r["length"]) for r in S.spans(df, ["k"], ["t"], "v").collect())
    assert got == [(1, 1, "", 0, 2), (1, 2, "a", 2, 2), (1, 3, "", 4, 1), (2, 1, "a", 0, 1)]


def test_as_of_brute_force(spark):
    rnd = random.Random(1)
    left = [(i, rnd.randrange(4), rnd.randrange(30)) for i in range(80)]
    right = [(rnd.randrange(4), rnd.randrange(30), rnd.randrange(100)) for _ in range(60)]
    got = {r["id"]: r["got"] for r in S.as_of(spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, t int, v int"), "k", "t", "v", "got").collect()}
    for i, k, t in left:
        there = [(rt, rv) for rk, rt, rv in right if rk == k and rt <= t]
        assert got[i] == (max(there)[1] if there else None)


def test_in_range_brute_force(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", "b", None]), rnd.choice([None, -5, rnd.randrange(-90, 90), rnd.randrange(900), 10**12 + rnd.randrange(10**11)]), rnd.choice([None, i])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at long, no int")
    reach = F.greatest(F.lit(3), F.expr("at div 7"))
    got = {(r["k"], r["at"]): (r["n"], r["least"]) for r in S.in_range(df, ["k"], "at", F.col("at") - reach, F.col("at") + 2 * reach, "no", "n", "least").collect()}
    want = {}
    for k, at in {(k, at) for k, at, _ in rows if k is not None and at is not None}:
        reach = max(3, at // 7)
        there = [no for other, v, no in rows if other == k and v is not None and at - reach <= v <= at + 2 * reach]
        want[k, at] = (len(there), min((no for no in there if no is not None), default=None))
    assert got == want


def test_in_range_of_empty_ranges(spark):
    df = spark.createDataFrame([("a", 1, 7), ("a", 5, 8)], "k string, at long, no int")
    ranges = {"nothing": (1, 0), "between": (2, 2), "other": (4, 4)}
    got = {name: sorted(tuple(r) for r in S.in_range(df, ["k"], "at", F.col("at") + low, F.col("at") + high, "no", "n", "least").collect()) for name, (low, high) in ranges.items()}
    assert got == {"nothing": [], "between": [], "other": [("a", 1, 1, 8)]}


def test_gaps(spark):
    df = spark.createDataFrame([(1, 2, 5), (1, 4, 6), (1, 8, 9), (2, 0, 10)], "k int, a int, b int")
    got = sorted(tuple(r) for r in S.gaps(df, ["k"], "a", "b", F.lit(0), F.lit(10)).collect())
    assert got == [(1, 0, 2), (1, 6, 8), (1, 9, 10)]


def test_budget_stops_at_first_overflow(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 1)], "k int, t int, n int")
    assert [r["t"] for r in S.within_budget(df, ["k"], ["t"], F.col("n"), F.lit(10)).collect()] == [1]


def test_empty(spark):
    df = spark.createDataFrame([], "k int, t int, v string")
    assert S.spans(df, ["k"], ["t"], "v").count() == 0
    assert S.top_n(df, ["k"], ["t"], 3).count() == 0


def test_zip_and_first_match(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, a string")
    b = spark.createDataFrame([(1, 9), (1, 8), (1, 7)], "k int, b int")
    assert sorted((r["a"], r["b"]) for r in S.zipped(a, b, ["k"], ["a"], ["b"]).collect()) == [("x", 7), ("y", 8)]
    assert sorted((r["a"], r["b"]) for r in S.first_match(a, b, "k", ["b"], "left").collect() if r["b"]) == [("x", 7), ("y", 7)]

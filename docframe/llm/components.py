"""Connected components of a link table by alternating large-star and small-star steps.

Each step is one minimum by node (combined before the shuffle) and one join, so no neighbour list is ever gathered; a
hub's links are split by Spark's skew join. Each round is written to the shared folder, which ends its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docframe.cluster import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v), u > v, each pair once."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that can be reached) for each node of edges (u, v); no row for others.

    Null ends and loops are left out; repeated edges count once.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = durable(now)
    state = _state(now)
    while state[0]:
        now = durable(_star(_star(now, True), False))
        after = _state(now)
        if after == state:
            break
        state = after
    least = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(least)

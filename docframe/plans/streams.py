"""Queries that run a stream to the end of the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.plans.registry import query
from docframe.streaming import events


@query("""
SELECT CAST(time_bucket(INTERVAL '1 day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2
""")
def s01_windowed_counts(spark, sf_dir):
    out = events.to_end(spark, events.windowed(events.read(spark, sf_dir), "1 day"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))

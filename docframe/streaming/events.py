"""Event streams: windowed counts with late data, once-per-key events, sessions, and a run to the end of a folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from docframe.cluster import shared_folder


def windowed(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, total of tumbling windows; rows later than `late` behind the newest are dropped."""
    at = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def once(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """user_id, session_start, n: runs of a user's events with less than `gap` between them."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", s.alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("session_start"), "n")


def to_end(spark: SparkSession, stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now and return its result table; state and results are in the shared folder."""
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    last: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        last.append(f"{place}/out/{number}")
        batch.write.mode("overwrite").parquet(last[-1])

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(*([last[-1]] if mode == "complete" else last))


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with ts as a timestamp."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))

"""Sinks with several sheets, page breaks and marks to escape; streams with repeats."""

import json

from pyspark.sql import functions as F

from docframe.sources import exports
from docframe.streaming import events

ROWS = [("f", 0, 0, "a<b", False), ("f", 0, 1, "", True), ("f", 1, 0, "x|y", False), ("g", 0, 0, None, None), ("bad", None, None, None, None)]
SCHEMA = "path string, sheet_no int, para_no int, text string, page_break_before boolean"


def bodies(df):
    return {r["path"]: r["body"] for r in df.collect()}


def test_exports(spark):
    p = spark.createDataFrame(ROWS, SCHEMA)
    assert bodies(exports.plain_text(p)) == {"f": "=== sheet 1 ===\na<b\n\f\n=== sheet 2 ===\nx|y", "g": ""}
    assert bodies(exports.markdown(p))["f"] == "## Sheet 1\n\na<b\n\n---\n\n\n## Sheet 2\n\nx\\|y"
    assert bodies(exports.html(p))["f"] == '<h2>Sheet 1</h2>\n<p>a&lt;b</p>\n<hr class="page"><p><br></p>\n<h2>Sheet 2</h2>\n<p>x|y</p>'
    assert json.loads(bodies(exports.json_model(p))["f"])["sheets"][0]["blocks"][1] == {"type": "paragraph", "text": "", "page_break_before": True}
    assert exports.plain_text(p.limit(0)).count() == 0


def test_report(spark, tmp_path):
    exports.report(spark.createDataFrame([("a", 1)], "file string, n int"), f"{tmp_path}/out")
    assert spark.read.option("sep", "\t").option("header", "true").csv(f"{tmp_path}/out").first()["file"] == "a"


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 7, "a", 1.0), (2, "2024-01-01 00:10:00", 7, "a", 2.0), (2, "2024-01-01 00:10:00", 7, "a", 2.0), (3, "2024-01-01 09:00:00", 7, "b", 4.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in/events.parquet")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r["event_type"], r["n"]) for r in events.to_end(spark, events.windowed(stream, "1 hour")).collect()) == [("a", 3), ("b", 1)]
    assert sorted(r["n"] for r in events.to_end(spark, events.sessions(stream, "30 minutes")).collect()) == [1, 3]
    assert events.to_end(spark, events.once(stream, ["event_id"]), "append").count() == 3

"""Session helpers: code shipping, the shared checkpoint folder, durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_WRITTEN: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python functions import there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="docframe-"), "docframe-code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "docframe")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores if a scan of few row groups gives fewer: for heavy work by row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where that is unset on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "docframe-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: the lineage ends there and survives lost executors.

    The tables stay until release() or the end of the driver's process.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_release_last)
    _WRITTEN.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that durable() wrote for this session; DataFrames that read them can't be used afterwards."""
    files = spark._jvm.org.apache.hadoop.fs
    for entry in [e for e in _WRITTEN if e[0] is spark]:
        path = files.Path(entry[1])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.remove(entry)


def _release_last() -> None:
    for spark in {id(s): s for s, _ in _WRITTEN}.values():
        try:
            release(spark)
        except Exception:  # noqa: BLE001  the session is gone already, and its folder with it or not
            continue

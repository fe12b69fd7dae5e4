"""Cutting the lineage of loops and of what is used more than once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir, which all executors share (our own where it is unset); it is
    deleted at the end."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/settled-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def settled(df: DataFrame) -> DataFrame:
    """df computed once and written as Parquet to the shared folder: its size is then known to the planner, and an executor
    lost later costs a read."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session may have ended before us
            return

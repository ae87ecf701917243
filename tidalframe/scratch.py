"""Folders that driver and executors share, for what a job writes and reads again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LEFT: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder: under spark.checkpoint.dir, or a temporary one where that is unset on a
    local master. It goes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tidalframe-")
    _LEFT.append((spark, path := f"{root.rstrip('/')}/tidalframe-{name}-{uuid.uuid4().hex}"))
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read from there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system layer, whatever store holds it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def sweep() -> None:
    """Remove what this driver has left."""
    while _LEFT:
        try:
            remove(*_LEFT.pop())
        except Exception:  # noqa: BLE001 - the session may already be gone at exit
            return

"""Shared plumbing of the training-data operators.

``scratch_root``/``stage`` cut lineage with Parquet tables in the folder that the
cluster names in ``spark.checkpoint.dir``; everything a job reads again lives there,
so a lost executor costs only the tasks it was running.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_ROOT: dict[str, str] = {}
_STAGED: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as a URI or path Spark can write."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _OWN_ROOT:
        _OWN_ROOT[sc.applicationId] = tempfile.mkdtemp(prefix="tidalframe-")
        sc.setCheckpointDir(_OWN_ROOT[sc.applicationId])
    return _OWN_ROOT[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the scratch root; removed when the session's driver exits."""
    path = f"{scratch_root(spark)}/tidalframe-{name}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the scratch folder and return a reader over it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system layer, whatever store holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def sweep() -> None:
    """Remove every staged table of this driver; results that read them end with it."""
    while _STAGED:
        spark, path = _STAGED.pop()
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may already be gone at exit
            return


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text column with null as the empty string."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def without_rows(docs: DataFrame, lost: DataFrame, same: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id and text hash are in ``lost``; of those in ``same``
    (rows that repeat both), one each stays. Both are (doc_id, text_hash) as xxhash64 gives it.

    Whether a side is broadcast is left to the planner, which checks its measured size.
    """
    keyed = docs.withColumns({"__id": docs["doc_id"].cast("long"), "__text": F.xxhash64(text_of(docs))})

    def on(keys: DataFrame):
        return keyed["__id"].eqNullSafe(keys["__k_id"]) & (keyed["__text"] == keys["__k_text"])

    lost, same = (stage(x.select(F.col("doc_id").alias("__k_id"), F.col("text_hash").alias("__k_text")), "row-keys") for x in (lost, same))
    if not same.limit(1).count():
        return keyed.join(lost, on(lost), "left_anti").drop("__id", "__text")
    keyed = stage(keyed.join(lost, on(lost), "left_anti"), "kept-rows")
    one = keyed.join(same, on(same), "left_semi")
    one = one.groupBy("__id", "__text").agg(F.first(F.struct(*docs.columns)).alias("r")).select("r.*")
    return keyed.join(same, on(same), "left_anti").drop("__id", "__text").unionByName(one)


def local_file(name: str) -> str:
    """Path of a public tokenizer file on this machine (driver or executor)."""
    import public_tokenizers

    path = public_tokenizers.path(name) if not os.path.isabs(name) else name
    return path

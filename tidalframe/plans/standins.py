"""Stand-ins: how the driver's tables play the roles of timelines, words and detections.

One hour of ``events.ts`` is one second of timeline (origin 2024-01-01); a conversation is a
spoken text with 0.4 s a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPAN, SPOKEN, FPS = 720.0, 0.4, 5
SILENCE, NEAR = 24.0, 30.0
#: Frames that are spelled out at once.
BLOCK = 1024


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, event_id, event_type, value, t, props): users as sources."""
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / F.lit(3.6e9)
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), "event_id", "event_type", "value", t.alias("t"), "props")


def numbered(events: DataFrame) -> DataFrame:
    """Events with ``idx`` 0, 1, ... in time by source."""
    return events.withColumn("idx", (F.row_number().over(Window.partitionBy("source_id").orderBy("t", "event_id")) - 1).cast("long"))


def spoken_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, turn, role, word_idx, word, start_s, end_s) of conversations."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_id"), "turn", "role", F.regexp_extract_all("text", F.lit(r"\S+"), 0).alias("w"))
    order = Window.partitionBy("source_id").orderBy("turn")
    before = F.coalesce(F.sum(F.size("w")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = turns.withColumn("before", before).select("source_id", "turn", "role", "before", F.posexplode("w").alias("k", "word"))
    idx = (F.col("before") + F.col("k")).cast("long")
    return rows.select("source_id", "turn", "role", idx.alias("word_idx"), "word", (idx * SPOKEN).alias("start_s"), ((idx + 1) * SPOKEN).alias("end_s"))


def sentence_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, cue_idx, start_s, end_s, text): sentences of conversations as cues."""
    pieces = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"[^.!?…]+[.!?…]*"), 0), lambda x: F.trim(x)), lambda x: x != "")
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_id"), "turn", F.posexplode(pieces).alias("k", "text"))
    order = Window.partitionBy("source_id").orderBy("turn", "k")
    turns = turns.withColumn("n", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), 0)))
    end = F.sum("n").over(order)
    return turns.select("source_id", (F.row_number().over(order.orderBy("turn", "k", "text")) - 1).cast("long").alias("cue_idx"), ((end - F.col("n")) * SPOKEN).alias("start_s"), (end * SPOKEN).alias("end_s"), "text")


def frame_grid(ends: DataFrame, fps: int) -> DataFrame:
    """(source_id, frame_idx) for 0 <= frame < end * fps of (source_id, end_s).

    Blocks of frames are dealt to a fixed number of tasks before they are spelled out: the planner
    would size its tasks by the few rows that there are before, and give all frames to one.
    """
    last = (F.ceil(F.col("end_s") * fps) - 1).cast("long")
    blocks = ends.where("end_s > 0").select("source_id", last.alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / BLOCK))).alias("block"))
    dealt = blocks.repartition(int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_id", "block")
    frames = F.sequence(F.col("block") * BLOCK, F.least((F.col("block") + 1) * BLOCK - 1, F.col("last")))
    return dealt.select("source_id", F.explode(frames).alias("frame_idx"))


def five_faces(events: DataFrame) -> DataFrame:
    """(source_id, idx, faces): each five consecutive events as faces of a 1920 x 1080 frame."""
    rows = numbered(events).withColumns({"g": F.floor(F.col("idx") / 5), "u": F.col("value") / 500})
    face = F.struct("idx", (F.col("u") * 1920).alias("cx"), F.lit(540.0).alias("cy"), (100 + 300 * F.col("u")).alias("w"), (100 + 200 * (1 - F.col("u"))).alias("h"), ((F.col("event_id") % 10) / 10.0).alias("score"))
    return rows.groupBy("source_id", F.col("g").alias("idx")).agg(F.array_sort(F.collect_list(face)).alias("faces"))

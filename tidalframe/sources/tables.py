"""JSON scans, the silence log, and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timefmt import format_clock
from .vtt import read_whole

WORDS = "segments array<struct<words:array<struct<word:string,start:double,end:double>>>>"
SPEAKERS = "start double, end double, speaker string"
CROPS = "start double, end double, crop_x int"
MEDIA = "width int, height int, fps double, total_frames bigint, duration_s double"


def words_of(files: DataFrame, offset: float = 0.0) -> DataFrame:
    """Transcriber words of (source_id, value): (source_id, word_idx, word, start_s, end_s), trimmed and shifted."""
    segments = files.select("source_id", F.posexplode(F.from_json("value", WORDS)["segments"]).alias("seg", "s"))
    words = segments.select("source_id", "seg", F.posexplode("s.words").alias("k", "w"))
    shifted = lambda c: F.col(f"w.{c}") + offset
    numbered = F.row_number().over(Window.partitionBy("source_id").orderBy("seg", "k")) - 1
    return words.select("source_id", numbered.alias("word_idx"), F.trim("w.word").alias("word"), shifted("start").alias("start_s"), shifted("end").alias("end_s"))


def words_json(spark: SparkSession, path: str, offset: float = 0.0) -> DataFrame:
    return words_of(read_whole(spark, path), offset)


def segments_of(files: DataFrame, schema: str) -> DataFrame:
    """JSON arrays of segments, one a (source_id, value), with their order as ``seg_idx``."""
    text = files.select("source_id", F.from_json("value", f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>").alias("s"))
    rows = text.select("source_id", F.posexplode("s").alias("seg_idx", "s")).select("source_id", "seg_idx", "s.*")
    return rows.withColumnsRenamed({"start": "start_s", "end": "end_s"})


def speakers_json(spark: SparkSession, path: str) -> DataFrame:
    return segments_of(read_whole(spark, path), SPEAKERS)


def crops_json(spark: SparkSession, path: str) -> DataFrame:
    return segments_of(read_whole(spark, path), CROPS)


def media_of(files: DataFrame) -> DataFrame:
    """Media facts of (source_id, value) JSON objects; a missing duration is frames / fps."""
    facts = files.select("source_id", F.from_json("value", MEDIA).alias("m")).select("source_id", "m.*")
    return facts.withColumn("duration_s", F.coalesce("duration_s", F.col("total_frames") / F.col("fps")))


def media_json(spark: SparkSession, path: str) -> DataFrame:
    return media_of(read_whole(spark, path))


def silence_log(logs: DataFrame, duration: str | None = None) -> DataFrame:
    """Silences of (source_id, value) logs: starts and ends in order.

    A silence still open at the end is closed at the column ``duration`` if one is named,
    else dropped.
    """
    number = lambda name: F.transform(F.regexp_extract_all("value", F.lit(rf"silence_{name}: (-?[0-9.]+)"), 1), lambda x: x.cast("double"))
    ends = number("end")
    if duration:
        ends = F.when(F.size(number("start")) > F.size(ends), F.concat(ends, F.array(F.col(duration)))).otherwise(ends)
    pairs = F.zip_with(number("start"), ends, lambda s, e: F.struct(s.alias("start_s"), e.alias("end_s")))
    rows = logs.select("source_id", F.posexplode(pairs).alias("seg_idx", "p")).select("source_id", "seg_idx", "p.*")
    return rows.where("start_s is not null and end_s is not null").withColumn("duration_s", F.col("end_s") - F.col("start_s"))


def write_json(df: DataFrame, path: str) -> None:
    """Result rows as JSON lines, one file for each partition."""
    df.write.mode("overwrite").json(path)


def json_array(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, value): the rows of each key as one JSON array, in order. For results cut to a few rows."""
    record = F.struct(*[c for c in rows.columns if c != key])
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), record.alias("record"))))
    return rows.groupBy(key).agg(F.to_json(F.transform(listed, lambda x: x["record"])).alias("value"))


def write_results(ranked: DataFrame, path: str, best: int = 5) -> None:
    """The first ``best`` rows by rank, and all, as one JSON array each under ``path``; the input
    is a top-k already, so an array is small."""
    for name, rows in (("final", ranked.where(F.col("rank") <= best)), ("all", ranked)):
        json_array(rows.withColumn("__key", F.lit(0)), "__key", "rank").select("value").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/{name}")


def record_json(rows: DataFrame) -> DataFrame:
    """``rows`` with ``record``: all their columns as one JSON object."""
    return rows.withColumn("record", F.to_json(F.struct(*rows.columns)))


def report_lines(ranked: DataFrame) -> DataFrame:
    """(rank, line_no, line): the console report of ranked passages (rank, final_score, start_s, end_s, hook, p1, p2)."""
    lines = F.array(
        F.format_string("#%d - SCORE: %d/100", "rank", F.bround("final_score", 0).cast("long")),
        F.concat(F.lit("Time: "), format_clock(F.col("start_s")), F.lit(" - "), format_clock(F.col("end_s"))),
        F.concat(F.lit("Hook: "), F.coalesce("hook", F.lit(""))),
        F.format_string("Phase scores: text=%.1f, audio=%.1f", "p1", "p2"),
    )
    return ranked.select("rank", F.posexplode(lines).alias("line_no", "line"))


#: Heading, rule and labels of the console report.
HEADING, RULE, THIN = "🎯 TOP 5 VIRAL PASSAGES FOR TIKTOK/REELS", "=" * 80, "-" * 80
LABELS = {"time": "⏱️  Time: ", "hook": "🎣 Hook: ", "quote": "💬 Best Quote: ", "phases": "📊 Phase Scores: ", "why": "📝 Why: "}


def full_report(ranked: DataFrame, best: int = 5) -> DataFrame:
    """(rank, line_no, line): the whole console report of ranked passages (rank, final_score, start_s,
    end_s, hook_text, best_quote, explanation, p1, p2); rank 0 holds the heading."""
    said = lambda label, c: F.concat(F.lit(LABELS[label]), F.coalesce(c, F.lit("")))
    lines = F.array(
        F.lit(""),
        F.format_string("#%d - SCORE: %d/100", "rank", F.bround("final_score", 0).cast("long")),
        said("time", F.concat(format_clock(F.col("start_s")), F.lit(" - "), format_clock(F.col("end_s")))),
        said("hook", F.col("hook_text")), said("quote", F.col("best_quote")),
        said("phases", F.format_string("Text=%.1f, Audio=%.1f", "p1", "p2")), said("why", F.col("explanation")), F.lit(THIN),
    )
    heading = ranked.sparkSession.range(1).select(F.lit(0).cast(ranked.schema["rank"].dataType).alias("rank"), F.posexplode(F.array(*map(F.lit, ("", RULE, HEADING, RULE)))).alias("line_no", "line"))
    return heading.unionByName(ranked.where(F.col("rank") <= best).select("rank", F.posexplode(lines).alias("line_no", "line")))


def trim_filter(keeps: DataFrame) -> DataFrame:
    """(source_id, graph): the trim and concat filter text of the keep segments in order."""
    piece = F.format_string("[0:v]trim=%.3f:%.3f,setpts=PTS-STARTPTS[v%d];[0:a]atrim=%.3f:%.3f,asetpts=PTS-STARTPTS[a%d]", "start_s", "end_s", "seg_idx", "start_s", "end_s", "seg_idx")
    rows = F.array_sort(F.collect_list(F.struct("seg_idx", piece.alias("p"))))
    chain = F.array_join(F.transform(rows, lambda x: x["p"]), ";")
    pads = F.array_join(F.transform(rows, lambda x: F.format_string("[v%d][a%d]", x["seg_idx"], x["seg_idx"])), "")
    return keeps.groupBy("source_id").agg(F.concat(chain, F.lit(";"), pads, F.format_string("concat=n=%d:v=1:a=1[v][a]", F.count(F.lit(1)))).alias("graph"))

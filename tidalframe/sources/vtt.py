"""Caption scans. Three dialects disagree on what a cue is, so each has its own reader.

All read whole files in parallel and frame cues with array functions; a file is one row until
its cues are exploded, so no order across rows is relied on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import timefmt as TF

ARROW = "-->"


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, value): whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_id"), "value")


def _lines(files: DataFrame) -> DataFrame:
    rows = F.split(F.regexp_replace("value", "\r", ""), "\n")
    return files.select("source_id", F.posexplode(rows).alias("line_no", "line"))


def framed_cues(files: DataFrame) -> DataFrame:
    """(source_id, cue_idx, start_text, end_text, lines): a cue is its time line and the lines
    up to the next blank or time line."""
    order = Window.partitionBy("source_id").orderBy("line_no")
    timed = F.col("line").contains(ARROW)
    closing = timed | (F.trim(F.col("line")) == "")
    rows = _lines(files).withColumns({"cue_idx": F.sum(timed.cast("int")).over(order) - 1, "timed": timed, "block": F.sum(closing.cast("int")).over(order)})
    head = F.max(F.when(F.col("timed"), F.col("block"))).over(Window.partitionBy("source_id", "cue_idx"))
    rows = rows.where("cue_idx >= 0").withColumn("head", head).where("block = head")
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("timed"), F.struct("line_no", "line")))), lambda x: x["line"])
    cues = rows.groupBy("source_id", "cue_idx").agg(F.max(F.when(F.col("timed"), F.col("line"))).alias("times"), body.alias("lines"))
    side = lambda i: F.trim(F.split_part("times", F.lit(ARROW), F.lit(i)))
    return cues.select("source_id", "cue_idx", side(1).alias("start_text"), F.split_part(side(2), F.lit(" "), F.lit(1)).alias("end_text"), "lines")


def separator_cues(files: DataFrame, flash_s: float = 0.02) -> DataFrame:
    """Settled lines of rolling captions: cues of less than ``flash_s`` with one untagged line."""
    start, end = TF.lenient_seconds(F.col("start_text")), TF.lenient_seconds(F.col("end_text"))
    line = F.trim(F.col("lines")[0])
    cues = framed_cues(files).where((end - start < flash_s) & (F.size("lines") == 1))
    return cues.where(~line.contains("<") & (line != "")).select("source_id", "cue_idx", start.alias("start_s"), line.alias("text"))


def text_between(cues: DataFrame, start_s: Column, end_s: Column, slack: float = 1.0) -> DataFrame:
    """(source_id, text): cues whose start lies within the bounds, widened by ``slack``."""
    near = cues.where(F.col("start_s").between(start_s - slack, end_s + slack))
    return near.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_idx", "text"))), lambda x: x["text"]), " ").alias("text"))


def all_cues(files: DataFrame) -> DataFrame:
    """Every cue with text: tags become spaces, lines are joined, rolling repeats stay."""
    text = F.array_join(F.transform("lines", lambda x: X.strip_tags(x)), " ")
    cues = framed_cues(files).select("source_id", "cue_idx", TF.strict_seconds(F.col("start_text")).alias("start_s"), TF.strict_seconds(F.col("end_text")).alias("end_s"), F.trim(text).alias("text"))
    return cues.where("text <> ''")


def word_cues(files: DataFrame, offset: float = 0.0, flash_s: float = 0.02) -> DataFrame:
    """Word timings (source_id, cue_idx, word_idx, word, start_s, end_s) of tagged lines.

    Times are shifted by ``offset``; cues that end at or before 0, and untagged flashes, are
    dropped; words before 0 are dropped. A word ends where the next begins, the last at the
    cue's end; a first word that would not last gets 0.1 s.
    """
    blocks = files.select("source_id", F.posexplode(F.split(F.regexp_replace("value", "\r", ""), "\n\n+")).alias("cue_idx", "block"))
    blocks = blocks.where(F.col("block").contains(ARROW))
    times = F.regexp_extract("block", r"(?m)^(.*-->.*)$", 1)
    body = F.regexp_replace("block", r"(?s)^.*?-->[^\n]*\n?", "")
    end_text = F.split_part(F.trim(F.split_part(times, F.lit(ARROW), F.lit(2))), F.lit(" "), F.lit(1))
    cues = blocks.select(
        "source_id", "cue_idx", (TF.colon_seconds(F.split_part(times, F.lit(ARROW), F.lit(1))) + offset).alias("s"),
        (TF.colon_seconds(end_text) + offset).alias("cue_end"), body.alias("body"),
    )
    cues = cues.withColumn("cue_start", F.greatest("s", F.lit(0.0))).where("cue_end > 0")
    cues = cues.where(F.col("body").contains("<") | (F.col("cue_end") - F.col("cue_start") > flash_s))
    lines = cues.select("*", F.posexplode(F.filter(F.split("body", "\n"), lambda x: x.contains("<"))).alias("line_idx", "line"))
    stamps = F.regexp_extract_all("line", F.lit(r"<(\d[\d:.]*)>"), 1)
    pieces = F.split("line", r"<\d[\d:.]*>")
    timed = F.zip_with(pieces, F.concat(F.array(F.lit(None).cast("string")), stamps), lambda w, t: F.struct(w.alias("raw"), t.alias("stamp")))
    words = lines.select("source_id", "cue_idx", "cue_start", "cue_end", "line_idx", F.posexplode(timed).alias("k", "w"))
    at = F.coalesce(TF.colon_seconds(F.col("w.stamp")) + offset, F.col("cue_start"))
    words = words.select("source_id", "cue_idx", "cue_start", "cue_end", (F.col("line_idx") * 100000 + F.col("k")).alias("k"), X.clean_word(F.col("w.raw")).alias("word"), at.alias("start_s"))
    words = words.where("word <> '' and start_s >= 0")
    order = Window.partitionBy("source_id", "cue_idx").orderBy("k")
    words = words.withColumns({"word_idx": F.row_number().over(order) - 1, "next": F.coalesce(F.lead("start_s").over(order), F.col("cue_end"))})
    end = F.when((F.col("word_idx") == 0) & (F.col("next") <= F.col("start_s")), F.col("start_s") + 0.1).otherwise(F.col("next"))
    return words.select("source_id", "cue_idx", "word_idx", "word", "start_s", end.alias("end_s"))

"""Windows over timelines: sentence-snapped passages, fills, averages, interpolation.

``filled``, ``smoothed``, ``interpolated`` and ``changes`` take sources of any length (see ``buckets``);
the Column forms of the same are for sources that fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ends_sentence
from .buckets import ROWS, SECONDS, last_known, neighbourhood
from .intervals import overlap_join


def joined(index: str, text: str, sep: str = " ") -> Column:
    """Aggregate: texts joined in the order of their index."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(index, text))), lambda x: x[text]), sep)


def sentence_windows(cues: DataFrame, target: float = 30.0, stride: float = 20.0, longest: float = 45.0, least: float = 20.0) -> DataFrame:
    """Passages of about ``target`` seconds every ``stride``, ended at a sentence end.

    Starts 0, stride, ... below the source's last end. Of the cues that overlap
    ``(start, start + longest)``, the passage ends with the sentence-final one, ending at or
    after ``start + least``, nearest to ``start + target`` (the first of equals), else at
    ``start + target``; windows without cues are skipped. Its text is all cues that overlap
    it. A cue meets its windows by arithmetic on the stride, not by a range join.
    """
    last = F.ceil(F.max("end_s").over(Window.partitionBy("source_id")) / stride) - 1
    first_k = F.greatest(F.floor((F.col("start_s") - longest) / stride), F.lit(0))
    last_k = F.least(F.ceil(F.col("end_s") / stride), F.col("last"))
    near = cues.withColumn("last", last).withColumn("last_k", last_k).where(F.col("last_k") >= first_k)
    near = near.withColumn("k", F.explode(F.sequence(first_k, F.col("last_k"))))
    near = near.withColumn("w_start", F.col("k") * stride).where((F.col("start_s") < F.col("w_start") + longest) & (F.col("end_s") > F.col("w_start")))
    final = ends_sentence(F.col("text")) & (F.col("end_s") >= F.col("w_start") + least)
    rank = F.when(final, F.struct(F.abs(F.col("end_s") - (F.col("w_start") + target)), F.col("cue_idx")))
    windows = near.groupBy("source_id", "k", F.col("w_start").alias("l_start")).agg(F.min_by("end_s", rank).alias("snap"))
    windows = windows.withColumn("l_end", F.coalesce("snap", F.col("l_start") + target)).drop("snap")
    held = overlap_join(windows, cues)
    out = held.groupBy("source_id", F.col("k").alias("passage_idx"), "l_start", "l_end").agg(joined("cue_idx", "text").alias("text"))
    return out.withColumnsRenamed({"l_start": "start_s", "l_end": "end_s"})


def forward_fill(value: Column | str, order: tuple[str, ...], default=None) -> Column:
    """The last known value so far, by source."""
    so_far = Window.partitionBy("source_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.last(value, ignorenulls=True).over(so_far)
    return filled if default is None else F.coalesce(filled, F.lit(default))


def moving_average(value: str, order: tuple[str, ...], reach: int = 15) -> Column:
    """Mean of the rows up to ``reach`` before and after, fewer at the edges."""
    return F.avg(value).over(Window.partitionBy("source_id").orderBy(*order).rowsBetween(-reach, reach))


def interpolate(x: str, y: str, known: Column) -> Column:
    """Piecewise linear value at x from the rows that are known; flat beyond the outer ones."""
    order = Window.partitionBy("source_id").orderBy(x)
    point = F.when(known, F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    left = F.last(point, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # The next known point is the last one seen on the way back; a frame that grows is never rebuilt.
    back = Window.partitionBy("source_id").orderBy(F.desc(x))
    right = F.last(point, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    slope = (right["y"] - left["y"]) / F.when(right["x"] > left["x"], right["x"] - left["x"])
    return F.coalesce(left["y"] + slope * (F.col(x) - left["x"]), left["y"], right["y"])


def difference(value: str, order: tuple[str, ...]) -> Column:
    return F.col(value) - F.lag(value).over(Window.partitionBy("source_id").orderBy(*order))


def filled(rows: DataFrame, value: Column, name: str, order: tuple[str, ...], default=None, width: float = SECONDS) -> DataFrame:
    """``rows`` with the last known value so far."""
    out = last_known(rows, {name: value}, order, width)
    return out if default is None else out.withColumn(name, F.coalesce(name, F.lit(default)))


def smoothed(rows: DataFrame, value: str, name: str, order: tuple[str, ...], reach: int = 15, width: float = SECONDS) -> DataFrame:
    """``rows`` with the mean of the rows up to ``reach`` before and after, fewer at the edges."""
    return neighbourhood(rows, F.avg(value), order, reach, name, width)


def interpolated(rows: DataFrame, x: str, y: str, known: Column, name: str, width: float = ROWS) -> DataFrame:
    """``rows`` with the piecewise linear value at x from the known rows; flat beyond the outer ones."""
    point = F.when(known, F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    out = last_known(last_known(rows, {"__left": point}, (x,), width), {"__right": point}, (x,), width, back=True)
    left, right = F.col("__left"), F.col("__right")
    slope = (right["y"] - left["y"]) / F.when(right["x"] > left["x"], right["x"] - left["x"])
    return out.withColumn(name, F.coalesce(left["y"] + slope * (F.col(x) - left["x"]), left["y"], right["y"])).drop("__left", "__right")


def changes(rows: DataFrame, value: str, name: str, order: tuple[str, ...], width: float = SECONDS) -> DataFrame:
    """``rows`` with the value less that of the row before; null at a source's first row."""
    held = last_known(rows, {"__before": F.struct(F.col(value).alias("v"))}, order, width, before=True)
    return held.withColumn(name, F.col(value) - F.col("__before.v")).drop("__before")


def global_rank(df: DataFrame, key: str, width: int = 4096) -> DataFrame:
    """``df`` with rank 1, 2, ... by a whole-number key, without one task for all rows.

    Rows are ranked within ranges of ``width`` keys, the ranges' counts are summed within
    ``width`` ranges each, and only the sums of these meet in one task: a row for each
    ``width`` squared keys.
    """
    bucket = F.floor(F.col(key) / width)
    so_far = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    counts = df.groupBy(bucket.alias("__b")).agg(F.count(F.lit(1)).alias("__n")).withColumn("__c", F.floor(F.col("__b") / width))
    wide = counts.groupBy("__c").agg(F.sum("__n").alias("__n")).select("__c", so_far(Window.orderBy("__c")).alias("__wide"))
    counts = counts.withColumn("__in", so_far(Window.partitionBy("__c").orderBy("__b"))).join(wide, "__c")
    counts = counts.select("__b", (F.col("__wide") + F.col("__in")).alias("__before"))
    local = df.withColumn("__b", bucket).withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(key)))
    return local.join(counts, "__b").withColumn("rn", F.col("__before") + F.col("__r")).drop("__b", "__r", "__before")


def in_batches(rn: Column, size: int = 25) -> tuple[Column, Column]:
    """(batch number from 0, place in the batch from 1) of a rank from 1."""
    return F.floor((rn - 1) / size), (rn - 1) % size + 1

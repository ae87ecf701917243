"""Interval joins, keep segments and merges.

Joins carry ``source_id`` as an equi key and meet on a dyadic grid (see ``dyadic``): an interval
is stored under a few nodes whatever its length, a point asks its nodes, and the exact
condition decides. First and last match are reductions on the unique segment index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buckets import ROWS, last_known
from .dyadic import stab


def interval_join(points: DataFrame, intervals: DataFrame, closed: bool = True, width: float = 1.0, how: str = "inner", slack: float = 0.0) -> DataFrame:
    """Rows of ``points`` (source_id, t) with each interval (source_id, start_s, end_s) that
    holds t: ``[start, end]`` if closed, else ``[start, end)``, widened by ``slack`` at the end.
    ``width`` is a grid cell's."""
    end = F.col("end_s") + slack
    upper = (F.col("t") <= end) if closed else (F.col("t") < end)
    return stab(points, F.floor(F.col("t") / width), intervals, F.floor(F.col("start_s") / width), F.floor(end / width), (F.col("t") >= F.col("start_s")) & upper, how)


def overlap_join(left: DataFrame, right: DataFrame, width: float = 1.0) -> DataFrame:
    """Pairs of (source_id, l_start, l_end) and (source_id, start_s, end_s) rows that overlap
    (open at both ends): of a pair one begins inside the other, which is the join of a point."""
    a, b = left.where("l_end >= l_start"), right.where("end_s >= start_s")
    cell = lambda c: F.floor(F.col(c) / width)
    meet = (F.col("start_s") < F.col("l_end")) & (F.col("end_s") > F.col("l_start"))
    later = stab(b, cell("start_s"), a, cell("l_start"), cell("l_end"), meet & (F.col("start_s") >= F.col("l_start")))
    earlier = stab(a, cell("l_start"), b, cell("start_s"), cell("end_s"), meet & (F.col("start_s") < F.col("l_start")))
    return earlier.unionByName(later)


def first_at_frame(grid: DataFrame, intervals: DataFrame, value: str, fps: float, slack: float = 0.0) -> DataFrame:
    """``grid`` (source_id, frame_idx) with the value of the first closed interval by seg_idx; null without one."""
    frames = grid.select("source_id", "frame_idx").withColumn("t", F.col("frame_idx") / fps)
    held = intervals.select("source_id", "seg_idx", F.col(value).alias("__value"), "start_s", (F.col("end_s") + slack).alias("end_s"))
    inside = (F.col("t") >= F.col("start_s")) & (F.col("t") <= F.col("end_s"))
    hit = stab(frames, F.col("frame_idx"), held, F.floor(F.col("start_s") * fps) - 1, F.ceil(F.col("end_s") * fps) + 1, inside)
    # A filter on the value makes the join an inner one, and estimates do not see that frames were spelled out.
    return grid.hint("merge").join(hit.groupBy("source_id", "frame_idx").agg(F.min_by("__value", "seg_idx").alias(value)), ["source_id", "frame_idx"], "left")


def last_at_frame(grid: DataFrame, intervals: DataFrame, value: str, fps: float, default=0) -> DataFrame:
    """``grid`` with the value of the last interval by seg_idx of those whose frames
    ``[int(start * fps), int(end * fps))`` hold the frame; ``default`` elsewhere."""
    held = intervals.select("source_id", "seg_idx", F.col(value).alias("__value"), (F.col("start_s") * fps).cast("long").alias("__first"), (F.col("end_s") * fps).cast("long").alias("__end"))
    hit = stab(grid.select("source_id", "frame_idx"), F.col("frame_idx"), held, F.col("__first"), F.col("__end") - 1, (F.col("frame_idx") >= F.col("__first")) & (F.col("frame_idx") < F.col("__end")))
    hit = hit.groupBy("source_id", "frame_idx").agg(F.max_by("__value", "seg_idx").alias(value))
    return grid.hint("merge").join(hit, ["source_id", "frame_idx"], "left").fillna({value: default})


def next_ending(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """As-of join: for each (source_id, t) the first interval by time that ends after t.

    Adds ``seg_idx``, and ``active`` (whether it has begun). Both sides are merged by time in
    one pass, without a range join: backwards, so that the next end is the last one seen.
    """
    hit = F.struct(F.col("seg_idx"), F.col("start_s"))
    ends = intervals.select("source_id", F.col("end_s").alias("t"), F.lit(0).alias("kind"), "seg_idx", hit.alias("hit"))
    asks = points.withColumn("kind", F.lit(1))
    merged = last_known(asks.unionByName(ends, allowMissingColumns=True), {"ahead": F.col("hit")}, ("t", "kind", "seg_idx"), back=True, before=True).where("kind = 1")
    return merged.withColumns({"seg_idx": F.col("ahead.seg_idx"), "active": F.coalesce(F.col("ahead.start_s") <= F.col("t"), F.lit(False))}).drop("kind", "hit", "ahead")


def segment_at_frame(grid: DataFrame, segments: DataFrame) -> DataFrame:
    """``grid`` (source_id, frame_idx) with seg_idx and crop_x of the first segment by seg_idx
    that ends after the frame, and of the last one beyond all ends."""
    hit = F.struct("seg_idx", "crop_x")
    ends = segments.select("source_id", (F.col("end_idx") - 1).alias("frame_idx"), F.lit(1).alias("kind"), "seg_idx", hit.alias("hit"))
    last = segments.groupBy("source_id").agg(F.max(hit).alias("last"))
    asks = grid.select("source_id", "frame_idx", F.lit(0).alias("kind"))
    # Of the segments that end later the first by number: with ends in order, the one last seen.
    ahead = last_known(asks.unionByName(ends, allowMissingColumns=True), {"ahead": F.col("hit")}, ("frame_idx", "kind", "seg_idx"), ROWS, back=True)
    at = ahead.where("kind = 0").join(last, "source_id", "left").withColumn("at", F.coalesce("ahead", "last"))
    return at.select("source_id", "frame_idx", F.col("at.seg_idx").alias("seg_idx"), F.col("at.crop_x").alias("crop_x"))


def nearest_face(faces: Column, cx: Column) -> Column:
    """The face whose cx is nearest; the first of equals."""
    best = F.array_min(F.transform(faces, lambda f, i: F.struct(F.abs(f["cx"] - cx).alias("d"), i.alias("i"))))
    return F.element_at(faces, best["i"] + 1)


def gaps(events: DataFrame, least: float, time: str = "t", order: tuple[str, ...] = ()) -> DataFrame:
    """Silences: spans longer than ``least`` between neighbouring events of a source."""
    held = last_known(events, {"start_s": F.col(time)}, (time, *order), before=True)
    return held.select("source_id", "start_s", F.col(time).alias("end_s")).where(F.col("end_s") - F.col("start_s") > least)


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Union of touching intervals: (source_id, seg_idx, start_s, end_s), numbered by start."""
    order = Window.partitionBy("source_id").orderBy("start_s", "end_s")
    reach = F.max("end_s").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start_s") <= reach, 0).otherwise(1)).over(order)
    merged = intervals.withColumn("__island", island).groupBy("source_id", "__island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    return merged.select("source_id", (F.row_number().over(Window.partitionBy("source_id").orderBy("start_s")) - 1).alias("seg_idx"), "start_s", "end_s")


def keep_segments(silences: DataFrame, totals: DataFrame, pad: float = 0.075, least: float = 0.15) -> DataFrame:
    """What stays when silences longer than ``least`` are cut, with ``pad`` left at both ends.

    ``totals`` is (source_id, total); a source without silences is kept whole.
    """
    order = Window.partitionBy("source_id").orderBy("start_s")
    real = silences.where(F.col("end_s") - F.col("start_s") > least)
    heads = real.select("source_id", F.coalesce(F.lag("end_s").over(order) - pad, F.lit(0.0)).alias("s"), (F.col("start_s") + pad).alias("e"))
    last = real.groupBy("source_id").agg((F.max_by("end_s", "start_s") - pad).alias("s"))
    tails = totals.join(last, "source_id", "left").select("source_id", F.coalesce("s", F.lit(0.0)).alias("s"), F.col("total").alias("e"))
    return merge_intervals(heads.union(tails).where("e > s").toDF("source_id", "start_s", "end_s"))


def cutter_segments(silences: DataFrame, totals: DataFrame, pad: float = 0.075) -> DataFrame:
    """Keep segments of the plain cutter: every silence cuts, touching results stay apart."""
    order = Window.partitionBy("source_id").orderBy("start_s")
    before = F.coalesce(F.lag("end_s").over(order) - pad, F.lit(0.0))
    heads = silences.select("source_id", before.alias("s"), F.col("start_s").alias("cut")).where("cut > s").select("source_id", "s", (F.col("cut") + pad).alias("e"))
    last = silences.groupBy("source_id").agg((F.max_by("end_s", "start_s") - pad).alias("s"))
    tails = totals.join(last, "source_id", "left").select("source_id", F.coalesce("s", F.lit(0.0)).alias("s"), F.col("total").alias("e")).where("s < e")
    rows = heads.union(tails)
    return rows.select("source_id", (F.row_number().over(Window.partitionBy("source_id").orderBy("s", "e")) - 1).alias("seg_idx"), F.col("s").alias("start_s"), F.col("e").alias("end_s"))


def remap_times(points: DataFrame, keeps: DataFrame) -> DataFrame:
    """Times on the cut timeline: t minus what was removed before it; null inside a cut.

    Keeps do not overlap, so the one that may hold a time is the last begun, an as-of join.
    """
    order = Window.partitionBy("source_id").orderBy("seg_idx")
    base = F.coalesce(F.sum(F.col("end_s") - F.col("start_s")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    begun = keeps.select("source_id", F.col("start_s").alias("t"), F.lit(0).alias("__kind"), F.struct("start_s", "end_s", base.alias("base")).alias("__keep"))
    asks = points.withColumn("__kind", F.lit(1))
    held = last_known(asks.unionByName(begun, allowMissingColumns=True), {"__keep": F.col("__keep")}, ("t", "__kind")).where("__kind = 1")
    inside = F.col("t") < F.col("__keep.end_s")
    return held.withColumn("t_cut", F.when(inside, F.col("__keep.base") + F.col("t") - F.col("__keep.start_s"))).drop("__kind", "__keep")

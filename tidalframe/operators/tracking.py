"""Face tracking decisions. Averages and fills take sources of any length (see ``buckets``); the
machines whose next state depends on comparisons stream the rows of a source, one machine a task;
tracking with recovery is cut where a frame alone decides its state."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .buckets import ROWS, last_known, linear_recurrence
from .buckets import numbered as place_in_source
from .dyadic import stab
from .speculation import chunked
from .streams import CONFIDENT, USUAL, Hysteresis, Recovery, Segmenter
from .windows import filled


def best_face(faces: Column, width: float) -> Column:
    """Stateless choice: area x (half + half centrality) x confidence; the first of equals."""

    def rated(f: Column, i: Column) -> Column:
        central = 1 - F.abs(f["cx"] - width / 2) / (width / 2)
        return F.struct((f["w"] * f["h"] * (0.5 + 0.5 * central) * f["score"]).alias("v"), (-i).alias("i"))

    return F.element_at(faces, 1 - F.array_max(F.transform(faces, rated))["i"])


def by_x(faces: Column) -> Column:
    """Faces from left to right; equals stay in order."""
    keyed = F.array_sort(F.transform(faces, lambda f, i: F.struct(f["cx"].alias("cx"), i.alias("i"), f.alias("f"))))
    return F.transform(keyed, lambda x: x["f"])


def first_position(samples: DataFrame, name: str, order: tuple[str, ...], default: float = 0.5) -> DataFrame:
    """``samples`` with cx of their first (most confident) face; without one the last known, or ``default``."""
    faces = F.col("faces")
    return filled(samples, F.when(F.size(faces) > 0, faces[0]["cx"]), name, order, default, ROWS)


def held_crop(frames: DataFrame, cx: Column, name: str, order: tuple[str, ...], width: int, crop_w: int) -> DataFrame:
    """``frames`` with the left edge of a crop on a frame's face (pixels); without one on the last known, before any
    on the middle of the frame. The last known position counts in whole pixels."""
    from ..functions.scoring import clamp, truncate

    held = filled(frames, cx, "__last", order, width=ROWS)
    last = F.coalesce(truncate(F.col("__last")), F.lit(width // 2))
    left = truncate(clamp(F.coalesce(cx, last.cast("double")) - crop_w / 2, F.lit(0.0), F.lit(float(width - crop_w))))
    return held.withColumn(name, left).drop("__last")


def mean_crop(series: DataFrame, value: str, width: int, height: int) -> DataFrame:
    """(source_id, crop_x): one crop for all frames, centred on the mean of their positions."""
    from ..functions.scoring import crop_left, crop_size

    crop_w, _ = crop_size(F.lit(width), F.lit(height))
    return series.groupBy("source_id").agg(F.avg(value).alias("cx")).select("source_id", crop_left(F.col("cx"), F.lit(width), crop_w).cast("long").alias("crop_x"))


def plausible(faces: Column, frame_h: float, most: float = USUAL, confidence: float = CONFIDENT) -> Column:
    """Faces neither wider nor taller than ``most`` of the frame's height; of these the confident
    ones if there are any."""
    sized = F.filter(faces, lambda f: (f["w"] <= most * frame_h) & (f["h"] <= most * frame_h))
    sure = F.filter(sized, lambda f: f["score"] >= confidence)
    return F.when(F.size(sure) > 0, sure).otherwise(sized)


def widest(faces: Column) -> Column:
    best = F.array_max(F.transform(faces, lambda f, i: F.struct(f["w"].alias("w"), (-i).alias("i"))))
    return F.element_at(faces, 1 - best["i"])


def target_face(faces: Column, speaker_cx: Column) -> Column:
    """No face: null (hold). One: that. More: nearest to the speaker, or the widest if unknown."""
    from .intervals import nearest_face

    several = F.when(speaker_cx.isNotNull(), nearest_face(faces, speaker_cx)["cx"]).otherwise(widest(faces)["cx"])
    return F.when(F.size(faces) == 1, faces[0]["cx"]).when(F.size(faces) > 1, several)


def start_position(frames: DataFrame, fps: float, seconds: float = 5.0, default: float = 0.5) -> DataFrame:
    """(source_id, start_cx): the widest face of the first early frame that has one."""
    early = frames.where(F.col("frame_idx") < int(fps * seconds)).where(F.size("faces") > 0)
    found = early.groupBy("source_id").agg(F.min_by(widest(F.col("faces"))["cx"], "frame_idx").alias("cx"))
    sources = frames.select("source_id").distinct()
    return sources.join(found, "source_id", "left").select("source_id", F.least(F.greatest(F.coalesce("cx", F.lit(default)), F.lit(0.0)), F.lit(1.0)).alias("start_cx"))


def ema_final(values: Column, alpha: float) -> Column:
    """Last EMA of an array, seeded with its first value."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), values[0].cast("double"), lambda s, x: alpha * s + (1 - alpha) * x)


def _streamed(rows: DataFrame, keys: list[str], columns: list[str], make, step, schema: str, finish=None) -> DataFrame:
    """A machine for each key over its rows by idx: ``step(machine, *columns)`` and, at the key's end,
    ``finish(machine)`` give output tuples, which follow source_id. A task keeps one machine."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = T.StructType.fromDDL(f"source_id {rows.schema['source_id'].dataType.simpleString()}, {schema}")
    arrow, n = to_arrow_schema(kinds), len(keys)

    def run(batches):
        key, machine = None, None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != key or machine is None:
                    if machine is not None and finish:
                        out += [(key[0], *x) for x in finish(machine)]
                    key, machine = row[:n], make()
                out += [(key[0], *x) for x in step(machine, *row[n:])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)
        if machine is not None and finish:
            out = [(key[0], *x) for x in finish(machine)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    assert len(names) + 1 == len(kinds)
    return rows.repartition(*keys).sortWithinPartitions(*keys, "idx").select(*keys, *columns).mapInArrow(run, kinds)


def ema_series(rows: DataFrame, alpha: float = 0.92, order: str = "idx", value: str = "x") -> DataFrame:
    """(source_id, idx, ema) of every row: the maps ``e -> alpha*e + (1 - alpha)*x`` composed in
    parallel, equal to the step-by-step machine but for rounding."""
    return linear_recurrence(rows, alpha, (1 - alpha) * F.col(value), order, value, "ema").withColumnRenamed(order, "idx")


def crop_bounds(width: int, height: int) -> tuple[float, float]:
    """Least and largest centre (0..1) of an upright 9:16 crop inside the frame."""
    least = min(int(height * 9 / 16), width) / (2 * width)
    return least, 1.0 - least


def hysteresis(samples: DataFrame, chunk: int | None = None, **params) -> DataFrame:
    """(source_id, idx, target) of samples (source_id, idx, faces of cx, w, score).

    ``bounds`` are those of ``crop_bounds`` where a crop follows. With ``chunk`` a source is run in
    chunks of that many samples side by side (see ``speculation``), else it is one task's.
    """
    step = lambda m, idx, faces: [(idx, m.step(faces or []))]
    if chunk:
        return chunked(samples, ["faces"], lambda idx: Hysteresis(**params), step, "idx long, target double", chunk)
    return _streamed(samples, ["source_id"], ["idx", "faces"], lambda: Hysteresis(**params), step, "idx long, target double")


def settling(faces: Column, width: float, height: float, usual: float = USUAL, relaxed: float = 0.7, least: float = 0.15) -> Column:
    """Whether a frame leaves ``Recovery`` in one state whatever its state before: one face alone is
    small enough for the relaxed limit, it also keeps the usual one, and even with its rating
    halved, which is the most that distance can take, it rates ``least``."""
    able = F.filter(faces, lambda f: (f["w"] <= height * relaxed) & (f["h"] <= height * relaxed))
    face = F.get(able, F.lit(0))
    value = face["w"] * face["h"] / (width * height) * 0.6 + face["score"] * 0.4
    alone = (F.size(able) == 1) & (face["w"] <= height * usual) & (face["h"] <= height * usual)
    return F.coalesce(alone & (value * 0.5 >= least), F.lit(False))


def track_with_recovery(frames: DataFrame, width: float, height: float, fps: float, **params) -> DataFrame:
    """(source_id, idx, crop_x) of frames (source_id, idx, faces of cx, cy, w, h, score in pixels).

    A source is cut at its settling frames: from each on, the machine runs without what came
    before. A stretch without such frames is one task's.
    """
    limits = {k: params[k] for k in ("usual", "relaxed", "least") if k in params}
    told = last_known(frames.select("source_id", "idx", "faces"), {"__from": F.when(settling(F.col("faces"), width, height, **limits), F.col("idx"))}, ("idx",), ROWS)
    told = told.withColumn("__from", F.coalesce("__from", F.lit(-(1 << 62))))
    make = lambda: Recovery(width, height, fps, **params)
    return _streamed(told, ["source_id", "__from"], ["idx", "faces"], make, lambda m, idx, faces: [(idx, m.step(faces or []))], "idx long, crop_x long")


def segment_by_median(rows: DataFrame, crop_w: float, fps: float, k: float = 0.15, src_w: int | None = None, chunk: int | None = None) -> DataFrame:
    """(source_id, seg_idx, start_idx, end_idx, crop_x): new segment where a value leaves the
    running median by more than k crop widths and the segment is long enough; with ``src_w``
    the crop stays inside the frame. With ``chunk`` a source is run in chunks of that many rows side
    by side (see ``speculation``), else it is one task's."""
    most = None if src_w is None else int(src_w - crop_w)
    if chunk:
        closed = lambda done: [] if done is None else [done]
        fresh = lambda idx: Segmenter(k * crop_w, int(1.5 * fps), most).restored((idx,))
        out = chunked(rows, ["x"], fresh, lambda m, idx, x: closed(m.step(float(x))), "start_idx long, end_idx long, crop_x long", chunk, lambda m: closed(m.close() if m.length else None))
        return place_in_source(out, ("start_idx",), ROWS, "seg_idx").select("source_id", "seg_idx", "start_idx", "end_idx", "crop_x")

    def numbered(m: Segmenter, done: tuple | None) -> list[tuple]:
        if done is None:
            return []
        m.count = getattr(m, "count", -1) + 1
        return [(m.count, *done)]

    return _streamed(
        rows, ["source_id"], ["x"], lambda: Segmenter(k * crop_w, int(1.5 * fps), most), lambda m, x: numbered(m, m.step(float(x))),
        "seg_idx long, start_idx long, end_idx long, crop_x long", lambda m: numbered(m, m.close() if m.length else None),
    )


def merge_short(segments: DataFrame, least: int) -> DataFrame:
    """A segment shorter than ``least`` extends its predecessor, whose crop_x stays."""
    from pyspark.sql import Window

    order = Window.partitionBy("source_id").orderBy("seg_idx")
    opens = (F.row_number().over(order) == 1) | (F.col("end_idx") - F.col("start_idx") >= least)
    island = F.sum(opens.cast("int")).over(order)
    merged = segments.withColumn("__island", island).groupBy("source_id", "__island").agg(
        F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"), F.min_by("crop_x", "seg_idx").alias("crop_x")
    )
    return merged.select("source_id", (F.col("__island") - 1).cast("long").alias("seg_idx"), "start_idx", "end_idx", "crop_x")


def segment_faces(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """``segments`` with avg_face_cx and avg_face_w of their ``frames`` (source_id, idx, face_cx,
    face_w), null where no frame of a segment has a face."""
    bounds = segments.select("source_id", "seg_idx", "start_idx", "end_idx")
    inside = (F.col("idx") >= F.col("start_idx")) & (F.col("idx") < F.col("end_idx"))
    held = stab(frames.select("source_id", "idx", "face_cx", "face_w"), F.col("idx"), bounds, F.col("start_idx"), F.col("end_idx") - 1, inside)
    means = held.groupBy("source_id", "seg_idx").agg(F.avg("face_cx").alias("avg_face_cx"), F.avg("face_w").alias("avg_face_w"))
    return segments.join(means, ["source_id", "seg_idx"], "left")


def cut_segments(frames: DataFrame, crop_w: float, fps: float, k: float = 0.15, src_w: int | None = None) -> DataFrame:
    """Cut, face means and quality of frames (source_id, idx, x, face_cx, face_w) in one flow.

    A short segment extends its predecessor, which keeps its own crop and means.
    """
    cut = segment_by_median(frames, crop_w, fps, k, src_w)
    told = segment_faces(frames, cut).select("source_id", "start_idx", "avg_face_cx", "avg_face_w")
    return centring(merge_short(cut, int(1.5 * fps)).join(told, ["source_id", "start_idx"]), crop_w)


def centring(segments: DataFrame, crop_w: float, limit: float = 0.1) -> DataFrame:
    """QA of segments (crop_x, avg_face_cx, avg_face_w): offset share, face share, OK / WARN / N/A."""
    offset = F.abs(F.col("avg_face_cx") - (F.col("crop_x") + crop_w / 2)) / crop_w
    verdict = F.when(F.col("avg_face_cx").isNull(), "N/A").when(offset <= limit, "OK").otherwise("WARN")
    return segments.withColumns({"offset_share": offset, "face_share": F.col("avg_face_w") / crop_w, "verdict": verdict})

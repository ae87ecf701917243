"""Scalar geometry and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(as_col(low), F.least(x, as_col(high)))


def truncate(x: Column) -> Column:
    """Toward zero, as a BIGINT."""
    return x.cast("long")


def crop_size(width: Column, height: Column) -> tuple[Column, Column]:
    """Size of the largest upright 9:16 rectangle in a frame."""
    crop_w = truncate(height * 9 / 16)
    return F.when(crop_w > width, width).otherwise(crop_w), F.when(crop_w > width, truncate(width * 16 / 9)).otherwise(height)


def crop_left(cx: Column, width: Column, crop_w: Column) -> Column:
    """Left edge of a crop centred on cx (0..1), inside the frame."""
    return clamp(truncate(cx * width - crop_w / 2), F.lit(0), width - crop_w)


def centre_crop(width: Column, height: Column, target_w: int, target_h: int) -> Column:
    """(x, y, w, h) of the centred rectangle with the target's ratio."""
    wider = width / height > target_w / target_h
    w = F.when(wider, truncate(height * target_w / target_h)).otherwise(width)
    h = F.when(wider, height).otherwise(truncate(width * target_h / target_w))
    return F.struct(truncate((width - w) / 2).alias("x"), truncate((height - h) / 2).alias("y"), w.alias("w"), h.alias("h"))


def safe_zone(crop_x: Column, face_cx: Column, crop_w: Column, width: Column, share: float = 0.6) -> Column:
    """Shift a crop so that the face lies in its middle ``share``, inside the frame."""
    margin = crop_w * (1 - share) / 2
    left, right = crop_x + margin, crop_x + crop_w - margin
    moved = F.when(face_cx < left, face_cx - margin).when(face_cx > right, face_cx + margin - crop_w).otherwise(crop_x)
    return clamp(truncate(moved), F.lit(0), width - crop_w)


def silence_score(ratio: Column) -> Column:
    return F.when(ratio < 0.15, F.lit(0.7)).when(ratio < 0.35, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - (ratio - 0.35) / 0.3))


def energy_score(rms: Column, variance: Column, rate: Column, silence: Column) -> Column:
    """Weighted score of normalised metrics, 0 to 10."""
    return (0.25 * rms + 0.35 * variance + 0.25 * rate + 0.15 * silence) * 10


def speaking_rate(words: Column, duration: Column) -> Column:
    return F.when(duration > 0, words / duration).otherwise(F.lit(0.0))


def min_max(x: Column, low: Column, high: Column) -> Column:
    """Position in [low, high]; 0.5 where they are equal."""
    return F.when(high == low, F.lit(0.5)).otherwise((x - low) / (high - low))


def fitted_font(size: Column, text_width: Column, width: Column) -> Column:
    """Smaller size where the test text is wider than 88 % of the frame."""
    return F.when(text_width > 0.88 * width, truncate(size * 0.85 * width / text_width)).otherwise(size)


def normalised_hit(hit: Column, source: Column) -> Column:
    """The common record of both detector shapes: clock strings or seconds, with defaults."""
    from .timefmt import clock_seconds

    clock = hit["start_time"].isNotNull()
    start = F.when(clock, clock_seconds(hit["start_time"])).otherwise(F.coalesce(hit["start_s"], F.lit(0.0)))
    end = F.when(clock, clock_seconds(hit["end_time"])).otherwise(F.coalesce(hit["end_s"], F.lit(0.0)))
    text = lambda n: F.coalesce(hit[n], F.lit(""))
    return F.struct(
        start.alias("start_s"), end.alias("end_s"), truncate(end - start).alias("duration"), text("hook_text").alias("hook_text"),
        text("punchline").alias("punchline"), text("why_viral").alias("why_viral"),
        F.coalesce(hit["viral_score"], F.lit(0)).alias("source_score"), source.alias("source"),
    )

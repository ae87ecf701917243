"""Timestamps: text forms to seconds (DOUBLE) and back. No form raises; see each default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hms(text: Column, pattern: str) -> tuple[Column, ...]:
    part = lambda g: F.regexp_extract(text, pattern, g)
    return part(1), part(2), part(3), part(4)


def _seconds(h: Column, m: Column, s: Column) -> Column:
    return h.cast("double") * 3600 + m.cast("double") * 60 + s.cast("double")


def lenient_seconds(text: Column) -> Column:
    """``HH:MM:SS.f`` with any number of fraction digits, read as thousandths whatever their
    number (``.5`` is 5 ms); what follows a space is dropped; anything else is 0."""
    h, m, s, f = _hms(F.trim(text), r"^(\d{2}):(\d{2}):(\d{2})\.(\d+)")
    return F.when(h != "", _seconds(h, m, s) + f.cast("double") / 1000).otherwise(F.lit(0.0))


def strict_seconds(text: Column) -> Column:
    """``HH:MM:SS.mmm`` at the start, three fraction digits; anything else is 0."""
    h, m, s, f = _hms(text, r"^(\d{2}):(\d{2}):(\d{2})\.(\d{3})")
    return F.when(h != "", _seconds(h, m, s) + f.cast("double") / 1000).otherwise(F.lit(0.0))


def colon_seconds(text: Column) -> Column:
    """One to three colon-separated parts, the last with a fraction; null if not numeric."""
    parts = F.split(F.trim(text), ":")
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    return (
        F.when(F.size(parts) == 3, number(1) * 3600 + number(2) * 60 + number(3))
        .when(F.size(parts) == 2, number(1) * 60 + number(2))
        .when(F.size(parts) == 1, number(1))
    )


def clock_seconds(text: Column) -> Column:
    """``HH:MM:SS[.f]``: exactly three parts, else null."""
    return F.when(F.size(F.split(text, ":")) == 3, colon_seconds(text))


def format_clock(seconds: Column) -> Column:
    """``HH:MM:SS``, truncating."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)


def format_label(seconds: Column) -> Column:
    """``M:SS``, truncating."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)


def transcript_line(seconds: Column, text: Column) -> Column:
    """``[12s / 0:12] text``."""
    return F.concat(F.lit("["), F.floor(seconds).cast("string"), F.lit("s / "), format_label(seconds), F.lit("] "), text)

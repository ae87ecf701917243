"""Energy metrics of passages and their normalised score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import energy_score, min_max, silence_score

DEFAULTS = {"rms": 0.1, "peak": 0.2, "energy_var": 0.01, "rate": 3.0, "silence_ratio": 0.2}


def rms(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.sqrt(F.avg(x * x))


def tumbling_variance(samples: DataFrame, keys: list[str], order: list[str], rate: int) -> DataFrame:
    """(keys, energy_var): population variance of the RMS of full runs of ``rate`` samples.

    A partial last run is dropped; fewer than two runs give 0.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    runs = samples.select(*keys, "amp", F.floor(place / rate).alias("run")).groupBy(*keys, "run").agg(rms("amp").alias("e"), F.count(F.lit(1)).alias("n"))
    full = F.when(F.col("n") == rate, F.col("e"))
    return runs.groupBy(*keys).agg(F.when(F.count(full) > 1, F.var_pop(full)).otherwise(F.lit(0.0)).alias("energy_var"))


def time_slice(samples: DataFrame, start_s: float, end_s: float, rate: int, index: str = "sample_idx") -> DataFrame:
    """Samples from ``start_s`` to before ``end_s``, both cut to whole milliseconds."""
    lo, hi = (int(int(t * 1000) * rate / 1000) for t in (start_s, end_s))
    return samples.where((F.col(index) >= lo) & (F.col(index) < hi))


def passage_metrics(samples: DataFrame, keys: list[str], duration: float, sub: Column) -> DataFrame:
    """One row a passage: word_count, rms, peak, energy_var (over ``sub`` windows), rate, silence_ratio.

    Two aggregations share the passage key: sub-windows first, then passages. The silence
    threshold is a twentieth of the passage's peak (0.01 where that is 0).
    """
    peak = F.max(F.abs("amp")).over(Window.partitionBy(*keys))
    level = F.when(peak > 0, 0.05 * peak).otherwise(F.lit(0.01))
    marked = samples.withColumns({"quiet": (F.abs("amp") < level).cast("int"), "sub": sub})
    square = F.sum(F.col("amp") * F.col("amp"))
    parts = marked.groupBy(*keys, "sub").agg(F.count(F.lit(1)).alias("n"), square.alias("sq"), F.max(F.abs("amp")).alias("pk"), F.sum("quiet").alias("q"))
    energy = F.sqrt(F.col("sq") / F.col("n"))
    return parts.groupBy(*keys).agg(
        F.sum("n").alias("word_count"), F.sqrt(F.sum("sq") / F.sum("n")).alias("rms"), F.max("pk").alias("peak"),
        F.when(F.count(F.lit(1)) > 1, F.var_pop(energy)).otherwise(F.lit(0.0)).alias("energy_var"),
        (F.sum("n") / duration).alias("rate"), (F.sum("q") / F.sum("n")).alias("silence_ratio"),
    )


def with_defaults(passages: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Passages with their metrics, defaults where a passage has none."""
    return passages.join(metrics, keys, "left").fillna(DEFAULTS)


def normalised_scores(metrics: DataFrame, source: str = "source_id") -> DataFrame:
    """``metrics`` with ``score``: min-max over the source of rms, energy_var and rate.

    The bounds are an aggregate joined back on the source, so no source's rows meet in a task.
    """
    names = ("rms", "energy_var", "rate")
    bounds = metrics.groupBy(source).agg(*[f(n).alias(f"{k}_{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))])
    rows = metrics.join(bounds, source)
    parts = [min_max(F.col(n), F.col(f"lo_{n}"), F.col(f"hi_{n}")) for n in names]
    scored = rows.withColumn("score", energy_score(*parts, silence_score(F.col("silence_ratio"))))
    return scored.drop(*[f"{k}_{n}" for n in names for k in ("lo", "hi")])

"""Exact quantiles by key where a few keys hold most rows.

Keys of few rows are aggregated as usual. A key with more than ``limit`` rows, and more than a
ten-thousandth of all, is never gathered: its value range is counted in bins, the bin that
holds the wanted rank becomes the new range, and so on until it holds ``limit`` rows or one value.
Every round is one pass of partial counts; at most 10 000 keys are that hot, so what is
broadcast and what comes back (``COUNTS`` bins in all) is bounded whatever the tables hold.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, SHARE, COUNTS = 65_536, 10_000, 65_536


def quantiles(rows: DataFrame, key: str, value: str, q: float = 0.5, limit: int = LIMIT) -> DataFrame:
    """(key, quantile, n): the interpolated quantile of each key's values, and how many there are.

    Nulls do not count; a key without values has a null quantile and n = 0. Values are finite.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v"))
    sizes = rows.groupBy("key").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = sizes.where(F.col("n") > max(limit, total // SHARE)).collect()  # fewer than SHARE rows
    kind = rows.schema["key"].dataType
    keys = spark.createDataFrame([(r.key,) for r in hot], T.StructType([T.StructField("hot", kind)]))
    light = rows.join(F.broadcast(keys), F.col("key").eqNullSafe(F.col("hot")), "left_anti")
    out = light.groupBy("key").agg(F.percentile("v", q).alias("quantile"), F.count("v").alias("n"))
    if hot:
        found = _selected(rows, hot, q, limit, kind)
        schema = T.StructType([T.StructField("key", kind), T.StructField("quantile", T.DoubleType()), T.StructField("n", T.LongType())])
        out = out.unionByName(spark.createDataFrame([(r.key, v, r.n) for r, v in zip(hot, found, strict=True)], schema))
    return out.withColumnRenamed("key", key)


def _selected(rows: DataFrame, hot: list, q: float, limit: int, kind: T.DataType) -> list[float]:
    """The quantile of each hot key, by counted ranges."""
    spark, wanted = rows.sparkSession, []  # (key, rank from 1, rows, least, greatest) of two ranks a key
    for r in hot:
        at = q * (r.n - 1)
        wanted += [[r.key, int(math.floor(at)) + 1, r.n, r.lo, r.hi], [r.key, int(math.ceil(at)) + 1, r.n, r.lo, r.hi]]
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("k", kind), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])

    def inside(ids: list[int]) -> DataFrame:
        ranges = spark.createDataFrame([(i, wanted[i][0], wanted[i][3], wanted[i][4]) for i in ids], schema)
        on = F.col("key").eqNullSafe(F.col("k")) & F.col("v").between(F.col("lo"), F.col("hi"))
        return rows.join(F.broadcast(ranges), on)  # at most two rows a hot key

    while wide := [i for i, (_, _, n, lo, hi) in enumerate(wanted) if n > limit and lo < hi]:
        bins = max(2, COUNTS // len(wide))
        span = F.col("hi") / 2 - F.col("lo") / 2  # halves, as the whole span may be beyond a double
        place = F.when(span > 0, F.floor((F.col("v") / 2 - F.col("lo") / 2) / span * bins)).otherwise((F.col("v") > F.col("lo")).cast("long"))
        counted = inside(wide).groupBy("id", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        done: set[int] = set()
        for c in sorted(counted.collect(), key=lambda c: (c.id, c.bin)):
            if c.id in done:
                continue
            if wanted[c.id][1] > c.n:
                wanted[c.id][1] -= c.n
            else:
                wanted[c.id][2:] = [c.n, c.lo, c.hi]
                done.add(c.id)
    narrow = [i for i, (_, _, _, lo, hi) in enumerate(wanted) if lo < hi]
    value = [w[3] for w in wanted]
    if narrow:
        ranks = spark.createDataFrame([(i, wanted[i][1]) for i in narrow], "id int, at int")
        held = inside(narrow).groupBy("id").agg(F.sort_array(F.collect_list("v")).alias("vs"))  # limit values at most
        for r in held.join(F.broadcast(ranks), "id").select("id", F.element_at("vs", F.col("at")).alias("v")).collect():
            value[r.id] = r.v
    out = []
    for i, r in enumerate(hot):
        part = q * (r.n - 1) % 1.0
        out.append((1 - part) * value[2 * i] + part * value[2 * i + 1])
    return out

"""Windows over sources of any length, bucket by bucket.

A source's rows are dealt by (source, bucket), a bucket being ``width`` units of the first order
column. What a window needs from before its bucket is carried in: each bucket leaves one row (its
last known value, its count, its linear map), only these rows meet by source, and their prefix is
joined back by (source, bucket). No task holds a source, however many of all rows it has.
Rows need a source and a place in its order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY, BUCKET = "source_id", "__bucket"
#: Seconds, and row numbers, in a bucket where a caller says nothing else.
SECONDS, ROWS = 60.0, 4096


def in_buckets(rows: DataFrame, order: str, width: float) -> DataFrame:
    return rows.withColumn(BUCKET, F.floor(F.col(order) / width).cast("long"))


def last_known(rows: DataFrame, values: dict[str, Column], order: tuple[str, ...], width: float = SECONDS, back: bool = False, before: bool = False) -> DataFrame:
    """``rows`` with the last value that is not null so far of each expression, under its name.

    ``before`` leaves the row's own value out; ``back`` runs from the source's end, so it gives
    the next known value. Rows alike in ``order`` have no defined order among themselves.
    """
    marks = {f"__v{i}": v for i, v in enumerate(values.values())}
    dealt = in_buckets(rows.withColumns(marks), order[0], width)
    way, pick = (F.desc, F.min_by) if back else (F.asc, F.max_by)
    place = F.struct(*order)
    edges = dealt.groupBy(KEY, BUCKET).agg(*[pick(m, F.when(F.col(m).isNotNull(), place)).alias(f"{m}_edge") for m in marks])
    earlier = Window.partitionBy(KEY).orderBy(way(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(KEY, BUCKET, *[F.last(f"{m}_edge", ignorenulls=True).over(earlier).alias(f"{m}_in") for m in marks])
    inside = Window.partitionBy(KEY, BUCKET).orderBy(*map(way, order)).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    # Dealt whatever the rows come by: what lies by source would be sorted as it lies, in as few tasks.
    local = dealt.repartition(KEY, BUCKET).withColumns({f"{m}_own": F.last(m, ignorenulls=True).over(inside) for m in marks})
    filled = local.join(carried, [KEY, BUCKET], "left").withColumns({n: F.coalesce(f"{m}_own", f"{m}_in") for n, m in zip(values, marks, strict=True)})
    return filled.select(*[c for c in rows.columns if c not in values], *values)


def numbered(rows: DataFrame, order: tuple[str, ...], width: float = SECONDS, name: str = "idx") -> DataFrame:
    """``rows`` with their place 0, 1, ... in the source."""
    dealt = in_buckets(rows, order[0], width)
    earlier = Window.partitionBy(KEY).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(KEY, BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.select(KEY, BUCKET, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__earlier"))
    local = F.row_number().over(Window.partitionBy(KEY, BUCKET).orderBy(*order)) - 1
    out = dealt.withColumn("__local", local).join(counts, [KEY, BUCKET])
    return out.withColumn(name, (F.col("__earlier") + F.col("__local")).cast("long")).drop(BUCKET, "__local", "__earlier")


def neighbourhood(rows: DataFrame, aggregate, order: tuple[str, ...], reach: int, name: str, width: float = SECONDS, rows_each: int = ROWS) -> DataFrame:
    """``rows`` with an aggregate over the rows up to ``reach`` before and after.

    Rows are numbered, and blocks of ``rows_each`` borrow ``reach`` rows from both neighbours.
    """
    rows_each = max(rows_each, reach)
    placed = numbered(rows, order, width, "__place")
    block, at = F.floor(F.col("__place") / rows_each), F.col("__place") % rows_each
    seen_by = F.filter(F.array(block, F.when(at < reach, block - 1), F.when(at >= rows_each - reach, block + 1)), lambda b: b.isNotNull())
    dealt = placed.withColumn("__own", block).withColumn("__block", F.explode(seen_by))
    near = Window.partitionBy(KEY, "__block").orderBy("__place").rowsBetween(-reach, reach)
    return dealt.withColumn(name, aggregate.over(near)).where("__block = __own").drop("__place", "__own", "__block")


def compose(a: np.ndarray, b: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix compositions of the maps ``x -> a*x + b`` by doubling; ``place`` counts within runs."""
    step = 1
    while (later := np.flatnonzero(place >= step)).size:
        na, nb = a.copy(), b.copy()
        na[later] = a[later] * a[later - step]
        nb[later] = a[later] * b[later - step] + b[later]
        a, b, step = na, nb, 2 * step
    return a, b


def linear_scan(rows: DataFrame, keys: list[str], order: str, a: Column, b: Column) -> DataFrame:
    """``rows`` with ``scan_a`` and ``scan_b``: the composed map of all rows of the key so far.

    ``keys`` are whole numbers. A task streams its sorted rows; between Arrow batches it keeps one
    map, that of the key it is in.
    """
    made = rows.withColumns({"scan_a": a.cast("double"), "scan_b": b.cast("double")})
    at = [made.columns.index(k) for k in keys]
    first = len(made.columns) - 2

    def run(batches):
        last, carry = None, (1.0, 0.0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in at]
            opens = np.zeros(n, bool)
            opens[0] = True
            for c in columns:
                opens[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(opens)
            place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
            sa, sb = compose(batch.column(first).to_numpy(zero_copy_only=False), batch.column(first + 1).to_numpy(zero_copy_only=False), place)
            if last == [c[0] for c in columns]:
                end = starts[1] if len(starts) > 1 else n
                sb[:end] += sa[:end] * carry[1]
                sa[:end] *= carry[0]
            last, carry = [c[-1] for c in columns], (sa[-1], sb[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:first], pa.array(sa), pa.array(sb)], names=batch.schema.names)

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in made.schema.fields])
    return made.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def linear_recurrence(rows: DataFrame, a: float, b: Column, order: str, first: str, name: str, width: float = ROWS) -> DataFrame:
    """(source_id, order, name): ``y = a*y + b`` along each source, from the first row's ``first``.

    Each bucket composes its own maps, the buckets' maps are composed by source, and what comes
    out before a bucket goes through the maps of its rows.
    """
    dealt = in_buckets(rows.select(KEY, F.col(order).alias("__at"), F.col(first).cast("double").alias("__x"), b.alias("__b")), "__at", width)
    local = linear_scan(dealt, [KEY, BUCKET], "__at", F.lit(a), F.col("__b"))
    last = F.max_by(F.struct("scan_a", "scan_b"), "__at")
    maps = local.groupBy(KEY, BUCKET).agg(last.alias("m"), F.min_by("__x", "__at").alias("__seed"))
    along = Window.partitionBy(KEY).orderBy(BUCKET)
    opens = F.lag(BUCKET).over(along).isNull()
    a_of, b_of = F.col("m.scan_a"), F.col("m.scan_b")
    # The first bucket's map takes the seed, so every composed map is the value at a bucket's end.
    maps = maps.select(KEY, BUCKET, "__seed", F.when(opens, 0.0).otherwise(a_of).alias("__a"), F.when(opens, a_of * F.col("__seed") + b_of).otherwise(b_of).alias("__m"))
    ends = linear_scan(maps, [KEY], BUCKET, F.col("__a"), F.col("__m"))
    enters = ends.select(KEY, BUCKET, F.coalesce(F.lag("scan_b").over(along), "__seed").alias("__enters"))
    out = local.join(enters, [KEY, BUCKET])
    return out.select(KEY, F.col("__at").alias(order), (F.col("scan_a") * F.col("__enters") + F.col("scan_b")).alias(name))

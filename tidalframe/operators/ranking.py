"""Union, near-time dedup, fallback scores and top-k of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_hits(**detectors: DataFrame) -> DataFrame:
    """All hits of the detectors with their name as ``source``, order of detectors in ``det_idx``."""
    out = None
    for k, (name, hits) in enumerate(detectors.items()):
        part = hits.withColumns({"source": F.lit(name), "det_idx": F.lit(k)})
        out = part if out is None else out.unionByName(part)
    return out


def near_dedup(hits: DataFrame, gap: float = 30.0, key: str = "source_id", start: str = "start_s", score: str = "score", ident: str = "hit_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Kept hits with the columns ``carry``: in order of start, a hit within ``gap`` of the last kept
    one replaces it if it scores strictly higher, else it goes.

    A hit that comes ``gap`` or more after its predecessor always opens a kept one, so a source
    falls apart into islands. Two hits in one cell of ``gap`` seconds are nearer, so all borders
    lie between a cell's last and the next occupied cell's first hit, and are found on one row a cell.
    The hits of an island, not of a source, are folded.
    """
    names = [start, ident, score, *carry]
    rows = hits.select(key, *names).withColumn("__cell", F.floor(F.col(start) / gap))
    along = Window.partitionBy(key).orderBy("__cell")
    cells = rows.groupBy(key, "__cell").agg(F.min(start).alias("__first"), F.max(start).alias("__last"))
    near = F.col("__first") - F.lag("__last").over(along) < gap
    islands = cells.select(key, "__cell", F.sum(F.when(near, 0).otherwise(1)).over(along).alias("__island"))
    told = rows.join(islands, [key, "__cell"]).groupBy(key, "__island").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("hits"))

    def step(acc: Column, hit: Column) -> Column:
        held, kept = acc["held"], acc["kept"]
        opened = F.struct(hit.alias("held"), F.concat(kept, F.array(held)).alias("kept"))
        better = F.struct(hit.alias("held"), kept.alias("kept"))
        return F.when(hit[start] - held[start] >= gap, opened).when(hit[score] > held[score], better).otherwise(acc)

    begin = F.struct(F.col("hits")[0].alias("held"), F.slice("hits", 1, 0).alias("kept"))
    fold = F.aggregate(F.slice("hits", 2, F.size("hits")), begin, step, lambda acc: F.concat(acc["kept"], F.array(acc["held"])))
    return told.select(key, F.inline(fold))


def long_enough(hits: DataFrame, duration: str = "duration", actual: str | None = None, least: float = 20.0) -> DataFrame:
    """Clips of at least ``least`` seconds, as asked for and, with ``actual``, as made; a null
    length counts as 0. Ranks given before keep their gaps."""
    kept = hits.where(F.col(duration) >= least)
    return kept if actual is None else kept.where(F.coalesce(F.col(actual), F.lit(0.0)) >= least)


def scored_or_short(text: Column, score: Column, least: int = 50) -> tuple[Column, Column]:
    """(score, verdict): texts of at most ``least`` characters get 0 and ``text_too_short``."""
    long = F.length(text) > least
    return F.when(long, F.coalesce(score, F.lit(0))).otherwise(F.lit(0)), F.when(long, F.when(score.isNull(), "parse_error").otherwise("scored")).otherwise("text_too_short")


def back_join(batches: DataFrame, scores: DataFrame, size: int = 25) -> DataFrame:
    """Scores by (batch, id) joined to their rows; ids out of range and later repeats are dropped."""
    valid = scores.where((F.col("id") >= 1) & (F.col("id") <= size)).groupBy("batch", "id").agg(F.min("score").alias("score"))
    return batches.join(valid, ["batch", "id"])


def top(hits: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of an order, with ``rank`` from 1 (numbered after the cut)."""
    best = hits.orderBy(*order).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def at_most(ranked: DataFrame, n: int) -> DataFrame:
    """A second limit on ranked rows; it cannot bring back what a first one cut."""
    return ranked.where(F.col("rank") <= n)


def top_by(hits: DataFrame, n: int, key: str, *order: Column) -> DataFrame:
    """The first n rows of each key."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def every_nth(rows: DataFrame, index: str, step: int = 5, most: int = 500) -> DataFrame:
    """Systematic sample: every ``step``-th row by index, the first ``most`` of them."""
    return rows.where(F.col(index) % step == 0).orderBy(index).limit(most)

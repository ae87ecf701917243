"""Intervals on a dyadic grid: joins whose cost does not grow with an interval's length.

Time is cut into cells; the nodes of a level are runs of ``2^level`` cells. An interval of at most
``SHORT`` cells is stored under its cells, a longer one under the nodes it touches at the first even
level whose nodes are as long as itself, which are two at most; a point asks its node at each
level that occurs. Both sides meet by equality on
(source_id, level, node), each pair at most once, and the exact condition decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVEL, NODE, SHORT = "__level", "__node", 48


def level_of(lo: Column, hi: Column) -> Column:
    """0 for at most SHORT cells, else the first even level with nodes of hi - lo + 1 cells or more."""
    cells = hi - lo + 1
    return F.when(cells <= SHORT, 0).otherwise((2 * F.ceil(F.log2(cells.cast("double")) / 2)).cast("int"))


def node_at(cell: Column, level: Column) -> Column:
    return F.call_function("shiftright", cell.cast("long"), level)


def nodes_of(lo: Column, hi: Column) -> Column:
    """Numbers of the nodes at ``level_of`` that the cells lo..hi touch."""
    level = level_of(lo, hi)
    return F.sequence(node_at(lo, level), node_at(hi, level))


def with_nodes(intervals: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """A row for each node of each interval that has a cell, with ``__level`` and ``__node``."""
    held = intervals.withColumns({"__lo": lo.cast("long"), "__hi": hi.cast("long")}).where("__hi >= __lo")
    placed = held.withColumns({LEVEL: level_of(F.col("__lo"), F.col("__hi")), NODE: F.explode(nodes_of(F.col("__lo"), F.col("__hi")))})
    return placed.drop("__lo", "__hi")


def with_ancestors(points: DataFrame, cell: Column, noded: DataFrame, outer: bool = False) -> DataFrame:
    """A row for each level that ``noded`` uses (at most 32), with the point's node there."""
    levels = noded.agg(F.collect_set(LEVEL)).scalar()
    explode = F.explode_outer if outer else F.explode
    return points.withColumn(LEVEL, explode(levels)).withColumn(NODE, node_at(cell, F.col(LEVEL)))


def stab(points: DataFrame, cell: Column, intervals: DataFrame, lo: Column, hi: Column, exact: Column, how: str = "inner") -> DataFrame:
    """``points`` (with source_id) with each interval whose cells lo..hi hold their cell and for
    which ``exact`` holds (which is to imply that). ``left`` keeps points without one; each row of ``points`` counts by itself."""
    noded = with_nodes(intervals, lo, hi).withColumnsRenamed({"source_id": "__source", LEVEL: "__l", NODE: "__n"})
    asked = points if how == "inner" else points.withColumn("__point", F.monotonically_increasing_id())
    asked = with_ancestors(asked, cell, noded.withColumnRenamed("__l", LEVEL), outer=how != "inner")
    on = (F.col("source_id") == F.col("__source")) & (F.col(LEVEL) == F.col("__l")) & (F.col(NODE) == F.col("__n"))
    # Estimates do not see that rows were exploded, so neither side may be broadcast on their word.
    met = asked.hint("merge").join(noded, on & exact, how)
    if how != "inner":  # of a point's levels those that met something, else one
        hit = F.col("__source").isNotNull()
        own = Window.partitionBy("__point")
        met = met.withColumns({"__any": F.max(hit).over(own), "__first": F.min(F.coalesce(LEVEL, F.lit(-1))).over(own)})
        met = met.where(hit | (~F.col("__any") & (F.coalesce(LEVEL, F.lit(-1)) == F.col("__first")))).drop("__point", "__any", "__first")
    return met.drop(LEVEL, NODE, "__source", "__l", "__n")

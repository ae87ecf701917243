"""Operator 1: exact dedup with a heavy-hitter split, in DataFrame functions only.

1. Each text is normalised and digested (SHA-256); ``(doc_id, digest)`` is staged once.
2. Misra-Gries summaries (Spark's ``approx_top_k``: mergeable, ``tracked`` counters in all)
   name frequent digests. Their error is below 3.5 * rows / tracked, so every digest with
   more than twice that share is among the at most ``tracked / 7`` named ones.
3. Their exact winners (smallest id, count) come from a partial aggregation of a few rows
   per task and are broadcast: at most ``tracked / 7`` rows, whatever the corpus holds.
4. Copies of a winner are settled map-side. Rows that repeat the winner's own id are counted
   before the shuffle and dealt out again by part. What remains, whose groups are bounded to a
   ``7 / tracked`` share of the rows, goes through one ordinary shuffle on the digest.

Defined results: null text counts as empty, so null and blank-free empty texts are copies.
Null ids sort after every id and are kept only when a group holds nothing else; of rows
that repeat both id and text exactly one is kept. An empty table gives an empty result.
Only the two named columns are read, so clashing or extra columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stage, text_of

SPACES = r"[\x20\x09-\x0D]+"
SUMMARIES = 64
#: Parts in which the rows of one winner are counted and dealt out again.
PARTS = 256


def digest(docs: DataFrame, text_col: str = "text") -> Column:
    """SHA-256 of the space-normalised text."""
    return F.sha2(F.encode(F.regexp_replace(text_of(docs, text_col), SPACES, " "), "UTF-8"), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256) of the space-normalised texts."""
    return docs.select(docs[id_col].alias("doc_id"), digest(docs, text_col).alias("text_sha256"))


def frequent_digests(table: DataFrame, tracked: int) -> DataFrame:
    """Short hashes of the digests that the Misra-Gries summaries name; at most ``tracked / 7`` rows.

    Digests are dealt to ``SUMMARIES`` summaries by their hash, each with its share of the
    counters, so the tasks' partial summaries do not all meet in one reducer.
    """
    each = max(8, tracked // SUMMARIES)
    hashed = table.select(F.xxhash64("text_sha256").alias("route"))
    top = F.expr(f"approx_top_k(route, {max(1, each // 7)}, {each})")
    named = hashed.groupBy(F.pmod("route", F.lit(SUMMARIES))).agg(top.alias("top"))
    return named.select(F.explode("top").alias("t")).select(F.col("t.item").alias("route"))


def heavy_winners(table: DataFrame, tracked: int) -> DataFrame:
    """(text_sha256, w_id, w_size) of the named digests that several rows have; staged."""
    named = F.broadcast(frequent_digests(table, tracked))
    winners = (
        table.join(named, F.xxhash64(table["text_sha256"]) == named["route"], "left_semi")
        .groupBy("text_sha256")
        .agg(F.min("doc_id").alias("w_id"), F.count(F.lit(1)).alias("w_size"))
        .where("w_size > 1")
    )
    return stage(winners, "winners")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = 16_384) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    table = stage(digests(docs, id_col, text_col), "digests")
    marked = table.join(F.broadcast(heavy_winners(table, tracked)), "text_sha256", "left")
    heavy, own = F.col("w_size").isNotNull(), F.col("doc_id").eqNullSafe(F.col("w_id"))
    settled = marked.where(heavy & ~own).select(
        "doc_id", F.col("w_id").alias("keep_id"), F.col("w_size").alias("group_size"), F.lit(False).alias("kept"), "text_sha256"
    )
    # Rows alike in all that is returned: as many as were counted in each of some parts, one of them kept.
    parts = marked.where(heavy & own).groupBy("text_sha256", "doc_id", "w_size", F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part"))
    parts = stage(parts.agg(F.count(F.lit(1)).alias("n")), "winner-rows")
    first = F.broadcast(parts.groupBy("text_sha256").agg(F.min("part").alias("first")))  # a row a winner
    dealt = parts.join(first, "text_sha256").repartition("text_sha256", "part").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    dealt = dealt.select("doc_id", F.col("doc_id").alias("keep_id"), F.col("w_size").alias("group_size"), ((F.col("part") == F.col("first")) & (F.col("i") == 1)).alias("kept"), "text_sha256")
    group = Window.partitionBy("text_sha256")
    ranked = group.orderBy(F.col("doc_id").asc_nulls_last())
    rest = marked.where(~heavy).select(
        "doc_id",
        F.min("doc_id").over(group).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
        (F.row_number().over(ranked) == 1).alias("kept"),
        "text_sha256",
    )
    return settled.unionByName(dealt).unionByName(rest)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def keep_unique(spark: SparkSession, docs: DataFrame, sf_dir: str, tracked: int = 16_384) -> DataFrame:
    """Pipeline stage: one row of each group of equal texts stays, that of smallest id.

    Rows are told apart by their digest, so rows with other texts stay whatever their ids; of
    rows that repeat id and text one stays; a row without an id stays only where its group has
    no other. Null and empty texts are equal; an empty table gives an empty result.
    """
    table = stage(digests(docs), "digests")
    winners = F.broadcast(heavy_winners(table, tracked))
    rows = docs.withColumns({"__id": docs["doc_id"], "__digest": digest(docs)}).withColumn("__row", F.struct(*docs.columns))
    marked = rows.select("__id", "__digest", "__row").join(winners, F.col("__digest") == winners["text_sha256"], "left")
    heavy = F.col("w_size").isNotNull()
    # Copies of a heavy winner end here; its own rows, most often one, are aggregated before the shuffle.
    own = marked.where(heavy & F.col("__id").eqNullSafe(F.col("w_id"))).groupBy("__digest").agg(F.first("__row").alias("__row"))
    order = Window.partitionBy("__digest").orderBy(F.col("__id").asc_nulls_last())
    rest = marked.where(~heavy).withColumn("__rank", F.row_number().over(order)).where("__rank = 1")
    return own.select("__row.*").unionByName(rest.select("__row.*"))


OP1_SQL = r"""
with d as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
  from documents)
select doc_id,
       min(doc_id) over (partition by text_sha256) as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       row_number() over (partition by text_sha256 order by doc_id) = 1 as kept,
       text_sha256
from d
"""

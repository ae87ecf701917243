"""Operator 12: resampling towards a target distribution, with an exact distributed top k.

*Features.* Runs of one to ``max_words`` consecutive words fall into ``buckets`` by the CRC-32 of
their UTF-8 bytes. Words and their CRCs are found for whole blocks at once, one byte column at a
time, without a Python object per word.

*Weights.* Bucket counts of the corpus and of the target are summed in the tasks, then by one
small shuffle; what reaches the driver is an array of ``buckets`` numbers for each, whatever the
corpus holds. A document's weight is the sum of its features' gains, gathered from one array; a
Gumbel number from the hash of its id is added, so that the highest scores are a sample
without replacement in proportion to the weights.

*Selection.* The k-th key of the order (score falling, doc_id rising, row number) is found by
radix selection: the rows are counted by a key digit of ``DIGIT_BITS`` bits, the digit that holds
the k-th row is fixed, and the next digit counts only rows that share all fixed ones. Each
pass shuffles at most a digit's values per task, and a hot score or id narrows down like any other, by
the row number in the end. Only the drawn rows are sorted by range and ranked; the others
never leave their task.

Defined results: null texts have no words; documents without features have weight 0; documents
with fewer than ``least_words`` words are scored but never drawn; a null id is hashed as no
digits and sorts after every id; rows that repeat an id share its random number, and of
rows alike in score and id those read first come first; an empty target counts as no features;
an empty table gives an empty result. Columns named like the new ones are replaced.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, stage
from .textkernel import ALNUM, Words, blocks, words

BUCKETS = 10_000
#: Bits of a key counted in one pass: at most 2^16 counts reach the driver.
DIGIT_BITS = 16
#: Bytes of a word that are hashed column by column; what a longer word has beyond goes to zlib.
COLUMNS = 24
NEW = ("n_features", "weight", "score", "rank")
_ROW = "__row"


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte (reflected polynomial 0xEDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_TABLE = _crc_table()
_ALL = np.uint32(0xFFFFFFFF)


def crc_states(w: Words, pick: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC registers ``state`` carried over the bytes of the words ``pick``."""
    start, size = w.start[pick], (w.end - w.start)[pick]
    order = np.argsort(-size, kind="stable")
    start, falling, state = start[order], -size[order], state[order]
    for j in range(min(int(-falling[0]), COLUMNS) if len(falling) else 0):
        n = int(np.searchsorted(falling, -j, "left"))  # words of more than j bytes
        part = state[:n]
        state[:n] = _TABLE[(part ^ w.folded[start[:n] + j]) & np.uint32(255)] ^ (part >> np.uint32(8))
    for i in range(int(np.searchsorted(falling, -COLUMNS, "left"))):
        rest = w.folded[start[i] + COLUMNS : start[i] - falling[i]].tobytes()
        state[i] = zlib.crc32(rest, int(state[i] ^ _ALL)) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out


def feature_buckets(w: Words, max_words: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every feature of a block, by length and then by place."""
    doc, last = w.doc, np.repeat(w.doc_first[1:], np.diff(w.doc_first))
    place = np.arange(len(doc))
    state = np.full(len(doc), _ALL, np.uint32)
    docs, found = [], []
    for n in range(max_words):
        if n:  # a space, and the next word
            inside = place + n < last
            place, last, doc, state = place[inside], last[inside], doc[inside], state[inside]
            state = _TABLE[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))
        state = crc_states(w, place + n, state)
        docs.append(doc)
        found.append(((state ^ _ALL) % np.uint32(buckets)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(found)


def bucket_counts(texts: DataFrame, text_col: str = "text", max_words: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts; ``buckets`` numbers at the driver."""

    def count(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                sums += np.bincount(feature_buckets(words(block, ALNUM), max_words, buckets)[1], minlength=buckets)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[seen])], names=["bucket", "n"])

    counted = texts.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of shares) of each bucket."""
    buckets, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = lambda s, t: (t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(seed: str, doc_id) -> int:
    """The random part of a row's score, from its id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, text_col: str, id_col: str, max_words: int, seed: str, carry: list[str]) -> DataFrame:
    """The columns ``carry`` with n_words, n_features, weight and score."""
    made = ["__words", "n_features", "weight", "score"]
    asked = docs.select(*carry, docs[id_col].alias("__id"), docs[text_col].cast("string").alias("__text"))
    schema = T.StructType([*asked.schema.fields[:-2], *(T.StructField(n, T.LongType()) for n in made)])
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    buckets = len(gain)

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(len(carry) + 1)):
                w = words(block, ALNUM)
                doc, bucket = feature_buckets(w, max_words, buckets)
                weight = np.zeros(block.n_docs, np.int64)
                np.add.at(weight, doc, shared.value[bucket])
                part = batch.slice(block.first, block.n_docs)
                noise = np.array([gumbel(seed, i) for i in part.column(len(carry)).to_pylist()], np.int64)
                numbers = (np.diff(w.doc_first), np.bincount(doc, minlength=block.n_docs), weight, weight + noise)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], *(pa.array(x.astype(np.int64)) for x in numbers)], names=schema.names)

    return asked.mapInArrow(run, schema)


def first_keys(rows: DataFrame, keys: list[Column], k: int) -> Column | None:
    """The predicate of the first k rows in rising order of the long columns ``keys`` (no nulls).

    The last key is unique. Each pass reads the keys of ``rows`` (which should be staged) and
    counts one digit; the predicate is a few comparisons. None: no row is asked for.
    """
    if k <= 0:
        return None
    fixed, alike = F.lit(False), F.lit(True)  # rows before the k-th key's group; rows in it
    for key in keys:
        low, high, n = rows.where(alike).agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
        if n <= k:
            return fixed | alike
        left = (low ^ high).bit_length() if (low < 0) == (high < 0) else 64  # above, all rows agree
        unsigned = key.bitwiseXOR(F.lit(-(1 << 63)))
        while left:
            width = min(DIGIT_BITS, left)
            left -= width
            digit = F.shiftrightunsigned(unsigned, left).bitwiseAND(F.lit((1 << width) - 1))
            counted = rows.where(alike).groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).toArrow()
            order = np.argsort(counted["digit"].to_numpy())
            digits, sums = counted["digit"].to_numpy()[order], np.cumsum(counted["n"].to_numpy()[order])
            at = int(np.searchsorted(sums, k))
            before = int(sums[at - 1]) if at else 0
            fixed, alike = fixed | (alike & (digit < int(digits[at]))), alike & (digit == int(digits[at]))
            if sums[at] == k:
                return fixed | alike
            k -= before
    return fixed | alike


def ranked(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """``rows`` with their place (rank) in rising order of ``keys``: one range shuffle."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    part, at = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = stage(placed.withColumns({"__part": part, "__at": at}), "ranked")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).toArrow()  # a row a partition
    order = np.argsort(sizes["__part"].to_numpy())
    size = sizes["n"].to_numpy()[order]
    before = [(int(p), int(b)) for p, b in zip(sizes["__part"].to_numpy()[order], np.cumsum(size) - size, strict=True)]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "__part long, __before long"))
    return placed.join(offsets, "__part").withColumn("rank", F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def importance_resample(
    docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", target_text_col: str = "text", percent: int = 10, least_words: int = 20,
    max_words: int = 1, buckets: int = BUCKETS, seed: str = "2024", carry: list[str] | None = None,
) -> DataFrame:
    """The columns ``carry`` of all ``docs`` (default: all) with n_features, weight, score and rank.

    rank is the place among the drawn ``percent`` of the documents with ``least_words`` words or
    more, null for the others; ``where("rank is not null")`` is the sample.
    """
    carry = [c for c in carry or docs.columns if c not in NEW]
    gain = gains(bucket_counts(docs, text_col, max_words, buckets), bucket_counts(target, target_text_col, max_words, buckets))
    keyed = docs.withColumn("__key", docs[id_col].cast("long"))
    scored = weigh(keyed, gain, text_col, id_col, max_words, seed, [*carry, "__key"])
    scored = stage(scored.withColumn(_ROW, F.monotonically_increasing_id()), "scored")
    long_enough = F.col("__words") >= least_words
    drawable = scored.where(long_enough)
    k = percent * drawable.count() // 100
    keys = [-F.col("score"), F.col("__key").isNull().cast("long"), F.coalesce("__key", F.lit(0)), F.col(_ROW)]
    drawn = first_keys(drawable, keys, k)
    made = [*carry, "n_features", "weight", "score"]
    if drawn is None:
        return scored.select(*made, F.lit(None).cast("long").alias("rank"))
    drawn = long_enough & drawn
    first = ranked(scored.where(drawn), keys).select(*made, "rank")
    return first.unionByName(scored.where(~drawn).select(*made, F.lit(None).cast("long").alias("rank")))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (read(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return importance_resample(docs.select("doc_id", "text"), target, carry=["doc_id"])

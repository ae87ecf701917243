"""Operator 13: quality by support vectors over naive Bayes features.

*Features.* A document's features are the distinct runs of one to four bytes, the distinct runs of
one and two words, and the distinct patterns of runs of two to five words, which tell only what words
of the run are equal; all are hashed into ``2^BITS`` indicators. They are found for whole blocks at
once; of an indicator's places in a document the last one written to a shared slot counts, so
nothing is sorted.

*Ratios.* The indicators' document counts in both classes, over all labelled training rows, are
summed in the tasks and give each indicator its class log-count ratio. A row is the vector of the
ratios of its indicators, scaled to length one, whatever its text's length.

*Fit.* A linear model with hinge loss is fitted by dual coordinate descent: one multiplier a row,
each step solves its own box-bounded problem exactly and moves the weights along the row. The
margin becomes a probability by a logistic curve over margins of rows outside the fitted folds;
rows with equal features, such as copies, share a fold.

Bounds (documented parameters): rows of at most ``max_labelled`` labelled ids, those of least hash,
are training rows; the hinge-loss fit sees the first of them, in order of a hash of the row,
with ``max_entries`` indicators in all. Only these reach the driver. The ids are broadcast; the
documents are scored where they lie, without a shuffle.

Labels, lang, source and doc_id are never inputs of a score. Defined results: null and empty texts
have no indicators and get the score of the intercept; without labelled rows of both kinds every score
is the share of good ones (0.5 without any); of several labels of an id the greatest counts; rows
that repeat an id are scored alike by text, and all of them train; null ids and null labels are
not learned from; an empty table gives an empty result; a column named like the new one is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, stage, text_of
from .textkernel import NON_SPACE, Block, blocks, gram_hashes, mix64, words
from .toxicity import fit_logistic, held_out

MAX_LABELLED = 20_000
MAX_ENTRIES = 8_000_000
BITS = 18
BYTE_RUNS, PATTERN_WORDS = 4, 5
FOLDS = 3
#: Penalty of a unit of hinge loss; most passes over the rows; violation at which they end.
COST, EPOCHS, TOLERANCE = 4.0, 20, 0.02


def patterns(word: np.ndarray, n: int) -> np.ndarray:
    """For each run of n words, which of them equals which: the place of each word's first equal, as digits."""
    count = max(0, len(word) - n + 1)
    code = np.zeros(count, np.uint64)
    for j in range(1, n):
        place = np.full(count, j, np.uint64)
        for k in range(j - 1, -1, -1):
            place[word[k : k + count] == word[j : j + count]] = k
        code = code * np.uint64(n) + place
    return code


def indicators(block: Block) -> list[np.ndarray]:
    """The distinct indicators of each document of a block."""
    size, shift = len(block.data), np.uint64(64 - BITS)
    kinds: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # indicator of each place; where a document's places begin and end
    begin, end = block.offsets[:-1], block.offsets[1:]
    run, each = np.zeros(size, np.uint64), block.data.astype(np.uint64)
    for n in range(1, BYTE_RUNS + 1):
        run = run[: max(0, size - n + 1)] * np.uint64(256) + each[n - 1 :]
        kinds.append(((mix64(run + np.uint64(n << 40)) >> shift).astype(np.int32), begin, np.maximum(begin, end - n + 1)))
    w = words(block, NON_SPACE)
    first, last = w.doc_first[:-1], w.doc_first[1:]
    for n in (1, 2):
        kinds.append(((mix64(gram_hashes(w.hash, n) + np.uint64(n)) >> shift).astype(np.int32), first, np.maximum(first, last - n + 1)))
    for n in range(2, PATTERN_WORDS + 1):
        kinds.append(((mix64(patterns(w.hash, n) + np.uint64(n << 48)) >> shift).astype(np.int32), first, np.maximum(first, last - n + 1)))
    slot = np.empty(1 << BITS, np.int32)
    out = []
    for i in range(block.n_docs):
        ids = np.concatenate([k[a[i] : b[i]] for k, a, b in kinds])
        place = np.arange(len(ids), dtype=np.int32)
        slot[ids] = place
        out.append(ids[slot[ids] == place])
    return out


@dataclass
class Model:
    """Of each indicator its log-count ratio and its weight; intercept; the curve from margins to scores."""

    ratio: np.ndarray
    weight: np.ndarray
    intercept: float
    curve: tuple[float, float]

    def margin(self, ids: np.ndarray) -> float:
        r = self.ratio[ids]
        norm = math.sqrt(float(r @ r))
        return self.intercept + (float(r @ self.weight[ids]) / norm if norm else 0.0)

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * margins, -30, 30)))


def log_count_ratio(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """ln of the ratio of both classes' smoothed shares of an indicator; 0 where none has it."""
    p, q = good + 1.0, bad + 1.0
    return np.where(good + bad > 0, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS, tolerance: float = TOLERANCE, seed: int = 13) -> tuple[np.ndarray, float]:
    """(weights, intercept) of the hinge-loss model by dual coordinate descent; y is 1 or -1."""
    values = [ratio[ids] for ids in rows]
    values = [v / norm if (norm := math.sqrt(float(v @ v))) else v for v in values]
    curvature = [1.0 + float(v @ v) for v in values]  # the intercept is an indicator that all rows have
    alpha, weight, intercept = np.zeros(len(rows)), np.zeros(len(ratio)), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            ids, v = rows[i], values[i]
            slope = y[i] * (float(v @ weight[ids]) + intercept) - 1.0
            held = alpha[i]
            inward = min(slope, 0.0) if held <= 0 else max(slope, 0.0) if held >= cost else slope
            if abs(inward) < 1e-12:
                continue
            worst = max(worst, abs(inward))
            alpha[i] = min(max(held - slope / curvature[i], 0.0), cost)
            step = (alpha[i] - held) * y[i]
            weight[ids] += step * v
            intercept += step
        if worst < tolerance:
            break
    return weight, intercept


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str, max_labelled: int) -> DataFrame:
    """(key, y, ids) of the training rows; rows with equal indicators share a key."""
    known = labels.where(labels[label_col].isNotNull() & labels["doc_id"].isNotNull()).groupBy("doc_id").agg(F.max(labels[label_col].cast("int")).alias("y"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select(docs["doc_id"], text_of(docs).alias("text")).join(F.broadcast(known), "doc_id").select("text", "y")  # max_labelled small rows at most

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(0)):
                found = indicators(block)
                key = [int(mix64(ids.astype(np.uint64)).sum(dtype=np.uint64)) for ids in found]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(key, np.uint64).astype(np.int64)), batch.column(1).slice(block.first, block.n_docs), flat], names=["key", "y", "ids"])

    return rows.mapInArrow(run, "key long, y int, ids array<int>")


def class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each class, good and bad, that have an indicator; ``2^BITS`` numbers each."""

    def count(batches):
        sums = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            lists = batch.column(1)
            good = np.repeat(batch.column(0).to_numpy() == 1, np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten().to_numpy()
            sums += [np.bincount(flat[good], minlength=1 << BITS), np.bincount(flat[~good], minlength=1 << BITS)]
        seen = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[0, seen]), pa.array(sums[1, seen])], names=["i", "good", "bad"])

    counted = rows.select("y", "ids").mapInArrow(count, "i long, good long, bad long").groupBy("i").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    good, bad = np.zeros(1 << BITS), np.zeros(1 << BITS)
    good[counted["i"].to_numpy()], bad[counted["i"].to_numpy()] = counted["good"].to_numpy(), counted["bad"].to_numpy()
    return good, bad


def sample(rows: DataFrame, max_rows: int, max_entries: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(ids, y, key) of the first rows, in order of a hash of key and row number, within both bounds."""
    rows = rows.withColumn("at", F.xxhash64("key", "row"))
    slim = rows.select("at", "row", F.size("ids").alias("n")).orderBy("at", "row").limit(max_rows).toArrow()
    within = int(np.searchsorted(np.cumsum(slim["n"].to_numpy()), max_entries, "right"))
    if not within:
        return [], np.empty(0), np.empty(0, np.int64)
    at, row = slim["at"][within - 1].as_py(), slim["row"][within - 1].as_py()
    got = rows.where((F.col("at") < at) | ((F.col("at") == at) & (F.col("row") <= row))).select("at", "key", "y", "ids").toArrow().combine_chunks()
    order = np.argsort(got["at"].to_numpy(), kind="stable")
    lists = got["ids"].combine_chunks()
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    ids = [flat[offsets[i] : offsets[i + 1]] for i in order]
    return ids, np.where(got["y"].to_numpy() == 1, 1.0, -1.0)[order], got["key"].to_numpy()[order]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = MAX_LABELLED, max_entries: int = MAX_ENTRIES) -> Model:
    """Learn ratios, weights and curve from the training rows."""
    rows = labelled_rows(docs, labels, label_col, max_labelled)
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "labelled")
    ratio = log_count_ratio(*class_counts(rows))
    ids, y, key = sample(rows, max_labelled, max_entries)
    if len(set(y)) < 2:
        share = rows.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0]
        share = min(max(0.5 if share is None else share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, (math.log(share / (1 - share)), 0.0))
    fold = np.abs(key) % FOLDS
    margins, apart = np.zeros(len(y)), np.zeros(len(y), bool)
    for f in range(FOLDS):
        inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if len(set(y[inside])) < 2:
            continue
        counts = [np.bincount(np.concatenate([ids[i] for i in inside if y[i] == c]), minlength=1 << BITS) for c in (1, -1)]
        part = log_count_ratio(*counts)
        weight, intercept = fit_hinge([ids[i] for i in inside], y[inside], part)
        model = Model(part, weight, intercept, (0.0, 1.0))
        margins[outside] = [model.margin(ids[i]) for i in outside]
        apart[outside] = True
    weight, intercept = fit_hinge(ids, y, ratio)
    if len(set(y[apart])) < 2:  # too few different rows for folds
        model, apart = Model(ratio, weight, intercept, (0.0, 1.0)), np.ones(len(y), bool)
        margins = np.array([model.margin(x) for x in ids])
    curve = fit_logistic(margins[apart, None], (y[apart] > 0).astype(float))
    return Model(ratio, weight, intercept, (curve[0], curve[1]))


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the probability, by the model, that a text is of label 1."""
    docs = docs.drop(out_col)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(at)):
                margins = np.array([shared.value.margin(ids) for ids in indicators(block)])
                yield pa.RecordBatch.from_arrays([*batch.slice(block.first, block.n_docs).columns, pa.array(shared.value.score(margins))], names=schema.names)

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The documents whose score reaches ``least``, with their own columns."""
    return score(docs, model, out_col="__quality").where(F.col("__quality") >= least).select(*docs.columns)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidalframe.llm.importance import feature_buckets, first_keys, importance_resample, op12_importance, ranked
from tidalframe.llm.textkernel import ALNUM, blocks, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, max_words=1):
    found = WORD.findall((text or "").translate(LOWER))
    return [" ".join(found[i : i + n]) for n in range(1, max_words + 1) for i in range(len(found) - n + 1)]


def plainly(docs, target, max_words=1, buckets=10_000, percent=10, least=20):
    """Rows as the contract has them; docs: (doc_id, text) in the order in which they are read."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text, max_words)))
    for text in target:
        t.update(map(bucket, features(text, max_words)))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for i, text in docs:
        fs = features(text, max_words)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(features(text)) >= least])
    drawable = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(drawable[: percent * len(drawable) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in rows]


def rows_of(frame):
    return sorted(map(tuple, frame.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_features_equal_zlib():
    rng = random.Random(5)
    texts = ["", "A b", "ÀÉ" * 40, "x" * 100_000 + " y", None, *("".join(rng.choice("aBé7 -.日\n") for _ in range(rng.randrange(200))) for _ in range(300))]
    for n in (1, 2, 3):
        for block in blocks(pa.array(texts), 4000):
            doc, bucket = feature_buckets(words(block, ALNUM), n, 10_000)
            for i in range(block.n_docs):
                want = Counter(zlib.crc32(f.encode()) % 10_000 for f in features(texts[block.first + i], n))
                assert Counter(bucket[doc == i].tolist()) == want


def test_query_equals_the_contract(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = op12_importance(spark, sf)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert rows_of(got) == sorted(plainly(docs, target), key=repr)


@pytest.mark.parametrize("max_words", [1, 2])
def test_nulls_repeats_and_a_hot_row(spark, max_words):
    rng = random.Random(9)
    make = lambda: " ".join(rng.choice(["Ab", "cd", "é", "7", "zz"]) for _ in range(rng.randrange(0, 60)))
    rows = [(None if i % 17 == 0 else i % 50 - 10, make() if i % 5 else None) for i in range(400)] + [(3, "ab cd " * 15)] * 300
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(7)
    target = spark.createDataFrame([("ab zz zz",), (None,)], "text string")
    got = importance_resample(docs, target, percent=30, max_words=max_words, buckets=100)
    assert rows_of(got) == sorted(plainly(rows, ["ab zz zz", None], max_words, 100, 30), key=repr)
    assert got.columns == ["doc_id", "text", "n_features", "weight", "score", "rank"]


def test_empty_tables_and_nothing_to_draw(spark):
    docs = spark.createDataFrame([(1, "a " * 30), (2, None)], "doc_id long, text string")
    empty = docs.limit(0)
    assert importance_resample(empty, docs).count() == 0
    assert rows_of(importance_resample(docs, empty)) == sorted(plainly([(1, "a " * 30), (2, None)], []), key=repr)
    assert [r.rank for r in importance_resample(docs, docs, percent=100).where("doc_id = 1").collect()] == [1]


@pytest.mark.parametrize("k", [0, 1, 7, 499, 500, 501, 999, 1000])
def test_selection_of_wide_and_tied_keys(spark, k):
    big = (1 << 63) - 1
    rng = random.Random(k)
    rows = [(rng.choice([-big - 1, big, 0, 5, -5, rng.randrange(-big, big)]), rng.choice([0, -3, big]), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    keys = [F.col("a"), F.col("b"), F.col("c")]
    first = first_keys(df, keys, k)
    if not k:
        assert first is None
        return
    got = ranked(df.where(first), keys).orderBy("rank").collect()
    assert [(r.a, r.b, r.c) for r in got] == sorted(rows)[:k] and [r.rank for r in got] == list(range(1, k + 1))

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidalframe.llm import suffix_dedup as module
from tidalframe.llm.common import read
from tidalframe.llm.suffix_dedup import op10_suffix_dedup, suffix_dedup


def brute(texts, n=200):
    seen: dict = {}
    for raw in texts:
        for i in range(len(raw) - n + 1):
            k = raw[i : i + n]
            seen[k] = seen.get(k, 0) + 1
    out = []
    for raw in texts:
        gone = bytearray(len(raw))
        for i in range(len(raw) - n + 1):
            if seen[raw[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_equals_brute_force_on_made_texts(spark, hot):
    rng = random.Random(6)
    make = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [make(n) for n in (150, 199, 200, 210, 260, 400, 900)]
    texts = [None, "", "x", "ab" * 2000, "ab" * 150, "a" * 199, "a" * 200, "a" * 201, make(3000)]
    for _ in range(60):
        parts = [make(rng.randrange(0, 150))]
        for _ in range(rng.randrange(1, 4)):
            s = rng.choice(shared)
            lo = rng.randrange(0, 60) if rng.random() < 0.5 else 0
            parts += [s[lo : len(s) - (rng.randrange(0, 60) if rng.random() < 0.5 else 0)], make(rng.randrange(0, 120))]
        texts.append("".join(parts))
    texts += [texts[20], texts[20]]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (None, texts[21], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, core string").repartition(5)
    want = sorted(brute([(t or "").encode() for _, t, _ in rows]))
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(docs, hot=hot).collect())
    assert got == want


def test_query_on_documents(spark, sf):
    rows = [(r.doc_id, (r.text or "").encode()) for r in read(spark, sf, "documents").select("doc_id", "text").collect()]
    want = {(i, n, gone, spans, hashlib.sha256(kept).hexdigest()) for (i, _), (n, gone, spans, kept) in zip(rows, brute([t for _, t in rows]), strict=True)}
    assert {tuple(r) for r in op10_suffix_dedup(spark, sf).collect()} == want


def test_empty_table(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("held", [200_000, 3])
def test_hot_cores_over_many_buckets(spark, held):
    """A passage and a line that most documents hold, over more buckets than there are cores."""
    rng = random.Random(12)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, line = make(700), make(150)
    texts = [make(rng.randrange(40)) + (passage if i % 3 else line) + make(rng.randrange(90)) for i in range(120)]
    texts += [texts[1]] * 30 + ["z" * 300, "z" * 900]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, texts[1])] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = sorted(brute([t.encode() for _, t in rows]))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for hot in (20_000, 4):
            got = sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(docs, hot=hot, most_held=held).collect())
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_rows_of_one_id_are_told_apart_by_their_texts(spark, monkeypatch):
    """Two rows of one id, or none: the passage of one recurs, the other is whole. With one key for both it is not."""
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = make(260)
    want_texts = [passage + make(45), make(305), make(30) + passage]
    for ident in (7, None):
        docs = spark.createDataFrame([(ident, want_texts[0]), (ident, want_texts[1]), (9, want_texts[2])], "doc_id long, text string")
        with monkeypatch.context() as m:
            m.setattr(module, "row_digest", lambda text: F.lit(b"same"))
            wrong = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup(docs).collect())
        right = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup(docs).collect())
        assert right == sorted((len(raw), gone) for raw, (_, gone, _, _) in zip(want_texts, brute([t.encode() for t in want_texts]), strict=True))
        assert wrong != right

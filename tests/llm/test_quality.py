import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidalframe.llm.common import read
from tidalframe.llm.quality import BITS, fit, fit_hinge, indicators, keep_good, log_count_ratio, op13_quality, patterns, sample, score
from tidalframe.llm.textkernel import blocks


def test_indicators_do_not_depend_on_blocks_or_repeats():
    texts = ["abc abc", "", None, "é", "x y " * 5000, "abc abc"]
    whole = [set(x.tolist()) for b in blocks(pa.array(texts)) for x in indicators(b)]
    alone = [set(x.tolist()) for t in texts for b in blocks(pa.array([t], pa.string())) for x in indicators(b)]
    assert whole == alone and whole[0] == whole[5] and whole[1] == whole[2] == set()
    # a b c space; ab bc "c " " a"; abc "bc " "c a" " ab"; "abc " "bc a" "c ab" " abc"; abc; abc abc; equal words
    assert len(whole[0]) == 4 + 4 + 4 + 4 + 1 + 1 + 1
    assert all(len(x) == len(set(x.tolist())) for b in blocks(pa.array(texts)) for x in indicators(b))


@pytest.mark.parametrize("n", [2, 3, 5])
def test_patterns_tell_equal_words(n):
    rng = np.random.default_rng(n)
    word = rng.integers(0, 3, 300).astype(np.uint64)
    code = patterns(word, n)
    shape = [tuple(list(word[i : i + n]).index(x) for x in word[i : i + n]) for i in range(300 - n + 1)]
    assert len(code) == len(shape) and len(set(zip(code.tolist(), shape, strict=True))) == len(set(shape)) == len(set(code.tolist()))
    assert len(patterns(word[:1], n)) == 0


def test_hinge_fit_reaches_the_dual_optimum():
    """No model near the fitted one loses less."""
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(30) < 0.3) for _ in range(120)]
    y = np.array([1.0 if 3 in r or 5 in r else -1.0 for r in map(set, rows)])
    ratio = rng.normal(size=30)
    w, b = fit_hinge(rows, y, ratio, cost=1.0, epochs=5000, tolerance=1e-9)
    x = np.zeros((120, 30))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / max(np.linalg.norm(ratio[r]), 1e-12)
    loss = lambda w, b: 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = loss(w, b)
    assert best < loss(np.zeros(30), 0.0)
    assert all(loss(w + rng.normal(size=30) * s, b + rng.normal() * s) > best - 1e-6 for s in (0.001, 0.01, 0.1, 0.5) for _ in range(200))


def test_ratio_is_of_smoothed_shares():
    good, bad = np.array([3.0, 0.0, 0.0]), np.array([0.0, 1.0, 0.0])
    want = [np.log(4 / 6) - np.log(1 / 4), np.log(1 / 6) - np.log(2 / 4), 0.0]
    assert np.allclose(log_count_ratio(good, bad), want)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in read(spark, sf, "labels").collect()}
    rows = op13_quality(spark, sf).collect()
    assert len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    test = [(labels[r.doc_id], r.predicted, r.score) for r in rows if r.held_out and r.doc_id in labels]
    accuracy = sum(a == b for a, b, _ in test) / len(test)
    good, bad = [s for a, _, s in test if a], [s for a, _, s in test if not a]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    print(f"held out: {len(test)} rows, accuracy {accuracy:.4f}, area {auc:.4f}, good kept {np.mean([s >= 0.3 for s in good]):.4f}, bad kept {np.mean([s >= 0.3 for s in bad]):.4f}")
    assert accuracy > 0.97 and auc > 0.98


def test_odd_rows_and_tables(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, "", 0.5), (None, "x", 0.5), (2, "a b " * 60_000, 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = fit(docs, none)
    assert {r.score for r in score(docs, model).collect()} == {0.5}
    assert score(docs.limit(0), model).count() == 0 and score(docs, model).columns == ["doc_id", "text", "score"]
    one = spark.createDataFrame([(1, 1), (2, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert {r.score for r in score(docs, fit(docs, one)).collect()} == {1 - 1e-6} or fit(docs.limit(0), one)
    assert fit(docs.limit(0), one).curve[0] == 0.0


def test_learns_from_copies_and_repeated_ids_within_the_bounds(spark):
    rows = [(i, "plain words stand here" if i % 2 else "junk ### here %%%") for i in range(60)] + [(1, "plain words stand here")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = fit(docs, labels, max_labelled=40, max_entries=20_000)
    kept = keep_good(docs, model)
    assert kept.columns == docs.columns and {r.text for r in kept.collect()} == {"plain words stand here"}
    assert model.ratio.shape == (1 << BITS,)


def test_sample_keeps_its_bounds(spark):
    rows = spark.createDataFrame([(i // 3, i, i % 2, list(range(i % 5))) for i in range(50)], "key long, row long, y int, ids array<int>")
    ids, y, key = sample(rows, 20, 25)
    assert len(ids) == len(y) == len(key) <= 20 and sum(map(len, ids)) <= 25
    assert sample(rows.limit(0), 20, 25)[0] == []

import hashlib
import re

import numpy as np
import pytest
from test_bpe import reference
from test_near_dedup import brute

import corpus_pipeline
from tidalframe.llm.common import read


@pytest.fixture(scope="module")
def stages(spark):
    """Rows of each stage's input and result at sf0.01."""
    sf = "/root/testdata/sf0.01"
    docs, seen = read(spark, sf, "documents"), []
    for name, function in corpus_pipeline.STAGES:
        out = corpus_pipeline.stage(function(spark, docs, sf), "test-" + name)
        seen.append((name, docs.collect(), out.collect(), out.columns))
        docs = out
    return {name: (before, after, columns) for name, before, after, columns in seen}


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    first = stages["toxicity"][0][0].__fields__
    assert all(stages[n][2] == first for n, _ in corpus_pipeline.STAGES[:-1])


def test_toxicity_keeps_the_clean(spark, stages):
    before, after, _ = stages["toxicity"]
    labels = {r.doc_id: r.toxic for r in read(spark, "/root/testdata/sf0.01", "labels").collect()}
    kept = {r.doc_id for r in after}
    clean = [r.doc_id for r in before if labels.get(r.doc_id) == 0]
    assert np.mean([i in kept for i in clean]) > 0.98
    assert np.mean([i in kept for i, t in labels.items() if t]) < 0.5


def test_exact_dedup_equals_brute_force(stages):
    before, after, _ = stages["exact_dedup"]
    first: dict = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r.text or ""), r.doc_id)
    assert {r.doc_id for r in after} == set(first.values())


def test_near_dedup_equals_brute_force(stages):
    before, after, _ = stages["near_dedup"]
    assert {r.doc_id for r in after} == {i for i, _, _, kept in brute([(r.doc_id, r.text) for r in before]) if kept}


def test_decontamination_equals_brute_force(spark, stages):
    before, after, _ = stages["decontamination"]

    def words(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    grams, short = set(), set()
    for r in read(spark, "/root/testdata/sf0.01", "benchmark").collect():
        w = words(r.text)
        if w:
            n = min(10, len(w))
            (grams if n == 10 else short).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    sizes = {10} | {len(s) for s in short}
    windows = grams | short
    clean = {r.doc_id for r in before if not any(tuple(w[i : i + n]) in windows for w in [words(r.text)] for n in sizes for i in range(len(w) - n + 1))}
    assert {r.doc_id for r in after} == clean


def test_ids_equal_the_library(stages):
    before, after, _ = stages["bpe"]
    texts, library = {r.doc_id: r.text or "" for r in before}, reference()
    assert {r.doc_id for r in after} == set(texts)
    for r in after:
        assert r.token_ids == library.encode_ordinary(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """A folder with the tables the stages read besides their documents."""
    path = str(tmp_path_factory.mktemp("odd"))
    toxic = [(i, 1, int(i % 2)) for i in range(1000, 1400)]
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (None, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


ODD = "doc_id long, text string, lang string, source string, n_chars long, node string, score double"


@pytest.fixture(scope="module")
def odd_rows():
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(12))
    rows = [(1, own(1)), (1, own(1)), (2, own(1)), (2, own(2)), (None, own(3)), (None, own(3)), (3, None), (4, ""), (5, f"x {leak} y"), (None, leak), (6, "long " * 40_000 + own(6)), (7, own(7)), (8, own(7) + " end")]
    # Labelled documents to learn from; the toxic ones use words that the others do not.
    rows += [(i, ("you blithering numpty " if i % 2 else "the quiet river ") + own(i)) for i in range(1000, 1400)]
    return [(i, t, None, "s", None, "n", 0.5) for i, t in rows]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_empty_tables(spark, odd_dir, odd_rows, name):
    function = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(odd_rows, ODD).repartition(5)
    out = function(spark, docs, odd_dir)
    got = [(r.doc_id, r.text) if name != "bpe" else (r.doc_id, None) for r in out.collect()]
    texts = [(r[0], r[1]) for r in odd_rows]
    plain = [t for t in texts if t[0] is None or t[0] < 1000]
    kept = sorted((g for g in got if g[0] is None or g[0] < 1000), key=repr)
    if name == "toxicity":
        assert kept == sorted(plain, key=repr)
        assert not any(i is not None and i >= 1000 and i % 2 for i, _ in got) and sum(i is not None and i >= 1000 for i, _ in got) == 200
    elif name == "exact_dedup":
        want = {t: min((i for i, u in plain if (u or "") == (t or "") and i is not None), default=None) for _, t in plain if t}
        want[None] = 3
        assert kept == sorted(((i, t) for t, i in want.items()), key=repr)
    elif name == "near_dedup":
        assert (1, texts[0][1]) in kept and kept.count((1, texts[0][1])) == 1 and (2, texts[3][1]) in kept and (2, texts[0][1]) not in kept
        assert kept.count((None, texts[4][1])) == 1 and (3, None) in kept and (4, "") in kept and (7, texts[11][1]) in kept and not any(i == 8 for i, _ in kept)
    elif name == "decontamination":
        assert kept == sorted((t for t in plain if "alpha beta" not in (t[1] or "")), key=repr)
    else:
        assert len(got) == len(odd_rows)
    if name != "bpe":
        assert out.columns == docs.columns
    assert function(spark, docs.limit(0), odd_dir).count() == 0

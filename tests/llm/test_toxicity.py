import zlib

import numpy as np
import pytest

from tidalframe.llm.common import read
from tidalframe.llm.toxicity import LexiconTrie, Model, choose_terms, context_features, drop_toxic, errors_allowed, fit, fit_logistic, held_out, op5_toxicity, quoted, score, training_rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = np.random.default_rng(4)
    terms = {"".join(rng.choice(list("abc"), rng.integers(3, 11))): (1.0, bool(rng.integers(2))) for _ in range(25)}
    trie = LexiconTrie(terms)
    for _ in range(1500):
        word = "".join(rng.choice(list("abc"), rng.integers(3, 12)))
        want = None
        for term, (_, open_end) in terms.items():
            limit = min(errors_allowed(len(word)), errors_allowed(len(term) - 1 if open_end else len(term)))
            d = min(distance(word[:n], term) for n in range(len(word) + 1)) if open_end else distance(word, term)
            if d <= limit:
                want = d if want is None else min(want, d)
        got = trie.match(word)
        assert (None if got is None else got[1]) == want


def test_quotation_is_told_from_abuse():
    found = {"idiot": (5.0, 0)}
    abuse = context_features("you are an idiot!", found)
    quote = context_features('he wrote the word "idiot" in it', found)
    assert quoted('say "idiot" now', 5, 10) and not quoted("say idiot now", 4, 9)
    assert abuse[0] > quote[0] and quote[1] > abuse[1] == 0


def test_logistic_finds_the_direction():
    x = np.array([[0.0], [1.0], [2.0], [3.0]] * 10)
    w = fit_logistic(x, (x[:, 0] > 1.5).astype(float))
    assert w[1] > 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in read(spark, sf, "labels").collect()}
    rows = op5_toxicity(spark, sf).collect()
    assert len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    test = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in test) / len(test) > 0.97
    assert sum(a & b for a, b in test) / sum(a for a, _ in test) > 0.8


def test_odd_rows_and_tables(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, "", 0.5), (None, "x", 0.5), (2, "a b " * 30000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = fit(docs, labels)
    assert model.terms == {} and len({r.score for r in score(docs, model).collect()}) == 1
    assert score(docs.limit(0), model).count() == 0
    assert [r.h for r in docs.where("doc_id is null").select(held_out(docs.doc_id).alias("h")).collect()] == [False]


def test_model_travels_without_its_caches():
    import pickle

    m = Model({"idiot": (3.0, False)}, [0.0] * 7)
    m.hits({"idiot", "idoit"})
    assert pickle.loads(pickle.dumps(m)).hits({"idiot"}) == {"idiot": (3.0, 0)}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_stage_keeps_clean_documents(spark, sf):
    docs = read(spark, sf, "documents")
    labels = {r.doc_id: r.toxic for r in read(spark, sf, "labels").collect()}
    kept = drop_toxic(spark, docs, sf)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    clean = [i for i, t in labels.items() if not t]
    assert sum(i in ids for i in clean) / len(clean) > 0.98


def test_long_terms_allow_two_edits():
    m = Model({"blatherskite": (3.0, False), "numbskull": (2.0, True), "oaf": (1.0, False)}, [0.0] * 7)
    words = {"blahtersktie", "blahterskite", "blatherskite", "nubmskulls", "nmbskul", "oaf", "oat", "blhtersktie"}
    assert {w: e for w, (_, e) in m.hits(words).items()} == {"blatherskite": 0, "blahterskite": 2, "oaf": 0}


def test_words_of_any_length_match():
    m = Model({"idiot": (3.0, True), "numbskull": (2.0, False)}, [0.0] * 7)
    long = {"idiot" + "x" * 36, "idoit" + "x" * 200_000, "numbskull" + "s" * 60, "x" * 100_000}
    assert {w[:5] for w in m.hits(long)} == {"idiot"}
    m = Model({"blathers": (3.0, True)}, [0.0] * 7)
    assert {len(w): e for w, (_, e) in m.hits({"blaters" + "x" * 50, "blathers" * 3000, "blatrs" + "x" * 90}).items()} == {57: 1, 24000: 0}


def test_filter_passes_every_match():
    rng = np.random.default_rng(8)
    terms = {"".join(rng.choice(list("abcd"), rng.integers(3, 15))): (1.0, bool(rng.integers(2))) for _ in range(40)}
    trie = LexiconTrie(terms)
    for term in list(terms) * 40:
        word = list(term)
        for _ in range(rng.integers(0, 3)):
            at = int(rng.integers(len(word)))
            word[at : at + int(rng.integers(2))] = rng.choice(list("abcd"), rng.integers(2))
        word = "".join(word)
        assert trie.match(word) is None or trie.possible(word)


def test_bound_of_the_lexicon_is_on_chosen_terms():
    from types import SimpleNamespace as Row

    nested = [Row(term="insulting"[:n], open_end=True, toxic=50, g2=90.0 + n, weight=3.0) for n in (4, 5, 6, 7, 8)]
    rows = [*nested, Row(term="dunce", open_end=False, toxic=20, g2=40.0, weight=2.0), Row(term="clod", open_end=False, toxic=9, g2=31.0, weight=1.0)]
    assert set(choose_terms(rows, 2)) == {"insultin", "dunce"} and len(choose_terms(rows)) == 3


def test_only_copies_of_labelled_texts_collapse(spark):
    boilerplate = "terms of use apply here "
    texts = [boilerplate + f"text number {i} stands alone" for i in range(80)]
    rows = list(enumerate(texts)) + [(100 + i, texts[0].upper().replace(" ", "\n ")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    got = training_rows(docs, labels, 1000).collect()
    want = {(" ".join(t.lower().split()), int(i % 2 == 0)) for i, t in rows if i not in held}
    assert len(got) == len(want) and {(" ".join(r.text.lower().split()), r.toxic) for r in got} == want

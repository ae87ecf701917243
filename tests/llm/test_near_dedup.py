import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidalframe.llm.common import read
from tidalframe.llm.minhash import components, keep_representatives, near_dedup, pi, sigma
from tidalframe.llm.textkernel import NON_SPACE, blocks, lane_hashes, words


def brute(rows):
    sets = []
    for _, text in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    by_gram: dict = {}
    for k, s in enumerate(sets):
        for g in s:
            by_gram.setdefault(g, []).append(k)
    pairs = {p for v in by_gram.values() for p in itertools.combinations(v, 2)}
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        inter = len(sets[a] & sets[b])
        if 100 * inter >= 75 * len(sets[a] | sets[b]):
            up[find(a)] = find(b)
    low: dict = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        low[r] = min(low.get(r, i), i)
    return {(i, len(sets[k]), low[find(k)], i == low[find(k)]) for k, (i, _) in enumerate(rows)}


def test_equals_brute_force_on_documents(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {tuple(r) for r in near_dedup(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()}
    assert got == brute(rows)


def test_chains_hubs_and_odd_rows(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one  TWO"), (6, "three")]
    for k in range(40):  # a drifting chain: neighbours are linked, ends are not
        base = base[1:] + [f"x{k}"]
        rows.append((100 + k, " ".join(base)))
    shared = [f"s{k}" for k in range(30)]
    for k in range(20):  # share half of their words, linked with nothing
        rows.append((200 + k, " ".join(shared + [f"q{k}_{j}" for j in range(30)])))
    rows += [(300, "a b c d e f"), (300, "a b c d e f"), (301, "z y x w v u " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {tuple(r) for r in near_dedup(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()}
    assert got == brute(rows)


def test_null_ids_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", 1), (7, "a b c d e f", 2), (None, "u v w", 3)], "doc_id long, text string, node int")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in near_dedup(docs).collect())
    assert got == [(0, 0), (0, 7), (7, 7)]
    assert near_dedup(docs.limit(0)).count() == 0


def test_permutations_are_bijective_on_samples():
    x = np.arange(1 << 16, dtype=np.uint64) << np.uint64(32)
    assert len(np.unique(sigma(x))) == 1 << 16
    assert len(np.unique(pi(np.arange(1 << 16, dtype=np.uint32)))) == 1 << 16


@pytest.mark.parametrize("n", [2, 17])
def test_components_of_a_path(spark, n):
    links = spark.createDataFrame([(str(100 + i), str(101 + i)) for i in range(n)], "a string, b string")
    assert {r.label for r in components(links).collect()} == {"100"}


def test_stage_decides_by_row(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    a, b, other = " ".join(words), " ".join([*words[:-1], "end"]), " ".join(f"o{rng.random()}" for _ in range(20))
    rows = [(1, a, 1), (2, b, 2), (2, other, 3), (None, a, 4), (None, "lone words without id here", 5), (None, "lone words without id here", 6), (3, None, 7), (3, "", 8), (4, a, 9), (1, a, 10), (1, b, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash int").repartition(3)
    kept = keep_representatives(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    ones = [g for g in got if g[0] == 1]
    assert len(ones) == 1 and ones[0][1] in (a, b)
    assert [g for g in got if g[0] != 1] == sorted([(2, other), (None, "lone words without id here"), (3, None), (3, "")], key=repr)
    assert keep_representatives(spark, docs.limit(0), "").count() == 0


def test_one_large_mixed_bucket(spark):
    """Many near copies of one text and many texts that share half of it, all with one frequent line."""
    rng = random.Random(8)
    base, line = [f"b{i}" for i in range(80)], [f"l{i}" for i in range(12)]
    rows = []
    for k in range(150):
        near = list(base)
        near[rng.randrange(80)] = f"n{k}"
        rows.append((k, " ".join(line + near)))
    for k in range(60):
        rows.append((1000 + k, " ".join(line + base[:45] + [f"h{k}_{j}" for j in range(20)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {tuple(r) for r in near_dedup(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()}
    assert got == brute(rows)


def test_structured_words_are_not_linked(spark):
    """A Thue-Morse word and its complement, which polynomial hashes cannot tell apart."""
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = morse.translate(str.maketrans("ab", "ba"))
    for n in (128, 1024):
        docs = spark.createDataFrame([(1, morse[:n]), (2, other[:n]), (3, f"x {morse[:n]} y z u v"), (4, f"x {other[:n]} y z u v")], "doc_id long, text string")
        assert sorted((r.doc_id, r.component_id) for r in near_dedup(docs).collect()) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_word_hashes_depend_on_the_word_alone():
    rng = np.random.default_rng(3)
    made = ["".join(rng.choice(list("abc"), n)) for n in rng.integers(1, 30, 3000)] + ["a" * n for n in range(1, 600)] + ["b" * 250 + "a" * n for n in range(30)]
    got = {}
    for text in (" ".join(made), " ".join(made[::-1]) + " "):
        for block in blocks(pa.array([text, None, "", text[:50]]), 1 << 14):
            w = words(block, NON_SPACE, lane_hashes)
            for s, e, h in zip(w.start, w.end, w.hash.tolist(), strict=True):
                assert got.setdefault(w.folded[s:e].tobytes(), h) == h
    assert len(set(got.values())) == len(got) >= len(set(made))

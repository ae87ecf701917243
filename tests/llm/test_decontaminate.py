import hashlib
import random
import re

import pyarrow as pa

from tidalframe.llm.common import read
from tidalframe.llm.decontaminate import WindowSet, _scan, decontaminate, mark_hits, merge_runs, op3_decontaminate


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, n=10):
    windows = {}
    for i, text in items:
        w = words(text)
        size = min(n, len(w))
        for p in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + size]), set()).add(i)
    out = []
    for i, text in docs:
        w, hit, ids = words(text), set(), set()
        for size in {len(g) for g in windows}:
            for p in range(len(w) - size + 1):
                found = windows.get(tuple(w[p : p + size]))
                if found:
                    hit.update(range(p, p + size))
                    ids |= found
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_query_equals_brute_force(spark, sf):
    pairs = lambda t, k: [(r[0], r[1]) for r in read(spark, sf, t).select(k, "text").collect()]
    got = op3_decontaminate(spark, sf).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(tuple(r) for r in got) == brute(pairs("documents", "doc_id"), pairs("benchmark", "item_id"))


def test_blocks_short_items_and_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    items = [(1, item), (2, "Short One"), (3, None), (4, "..."), (1, item), (5, "é " * 12)]
    docs = [(1, f"x {item} y"), (2, "a SHORT, one b"), (3, None), (4, ""), (5, "short"), (6, "é " * 40), (6, "é " * 40), (7, "w " * 50_000 + item)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, n_words int").repartition(3)
    want = brute(docs, items)
    for size in (16 << 20, 40):
        marked = mark_hits(table, bench, block_bytes=size).collect()
        got = sorted((r.doc_id, r.n_words, sum(b - a for a, b in zip(r.hit_runs[::2], r.hit_runs[1::2], strict=True)), len(r.item_ids)) for r in marked)
        assert got == [w[:4] for w in want]
    kept = decontaminate(table, bench)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    cut = {r.doc_id: r.text for r in decontaminate(table, bench, "spans").collect()}
    assert cut[1] == "x  y" and cut[2] == "a  b" and cut[3] is None and cut[5] == "short"
    assert decontaminate(table, bench.limit(0)).count() == len(docs) and decontaminate(table.limit(0), bench).count() == 0


def test_a_window_set_is_small_and_quick():
    import pickle
    import time

    rng = random.Random(1)
    items = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(120))) for i in range(3000)]
    items += [(10_000 + i, "the same ten words in very many benchmark items here") for i in range(2000)]
    began = time.time()
    held = WindowSet(items, 10)
    assert time.time() - began < 5
    n_windows = sum(len(x[0]) for x in held.sizes.values())
    assert n_windows > 330_000 and len(pickle.dumps(held)) < 64 * n_windows
    text = items[7][1] + " the same ten words in very many benchmark items here"
    ((_, _, ids),) = list(_scan(pa.array([text]), held))
    assert {7, *range(10_000, 12_000)} == set(ids[0])


def test_runs_merge():
    assert merge_runs([(5, 8), (0, 3), (3, 4), (7, 9)]) == [0, 4, 5, 9]

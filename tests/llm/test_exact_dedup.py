import hashlib
import re

from tidalframe.llm.common import read
from tidalframe.llm.exact_dedup import exact_dedup, frequent_digests, keep_unique, op1_exact_dedup


def brute(rows):
    groups: dict = {}
    for i, text in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", text or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        for i in ids:
            out.append((i, min(ids), len(ids), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


def test_query_on_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in read(spark, sf, "documents").select("doc_id", "text").collect()]
    got = op1_exact_dedup(spark, sf).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_hot_groups_ties_nulls_and_extra_columns(spark):
    rows = [(i, "hot  text" if i % 3 else f"own {i}", i) for i in range(3000)] + [(9000, None, 0), (9001, "", 0), (1, "hot\ttext", 0), (None, "hot text", 0), (None, "lonely", 0), (9002, "x" * 200_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id int").repartition(6)
    got = exact_dedup(docs, tracked=512).collect()
    hot = [r for r in got if r.keep_id == 1]
    assert len(hot) == 2002 and all(r.group_size == 2002 for r in hot) and sum(r.kept for r in hot) == 1
    assert {r.doc_id: (r.keep_id, r.kept) for r in got if r.doc_id in (9000, 9001)} == {9000: (9000, True), 9001: (9000, False)}
    assert [r.kept for r in got if r.doc_id is None and r.keep_id is None] == [True]
    assert sum(r.group_size == 1 for r in got) == 1002


def test_summary_names_what_is_frequent(spark):
    table = spark.range(20_000).selectExpr("case when id % 4 = 0 then 'hot' else sha2(cast(id as string), 256) end as text_sha256")
    named = {r.route for r in frequent_digests(table, 512).collect()}
    assert spark.sql("select xxhash64('hot')").first()[0] in named and len(named) <= 512 // 7 + 64


def test_stage_keeps_one_of_each(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c"), (None, "a b")], "doc_id long, text string")
    assert {r.doc_id for r in keep_unique(spark, docs, "").collect()} == {1, 3}
    assert exact_dedup(docs.limit(0)).count() == 0


def test_rows_that_repeat_the_winner(spark):
    rows = [(7, "hot", i) for i in range(900)] + [(None, "nobody", i) for i in range(900)] + [(8, "hot", 0)] * 40 + [(i, f"own {i}", 0) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int").repartition(6)
    got = exact_dedup(docs, tracked=512).collect()
    assert len(got) == len(rows)
    groups = {t: [r for r in got if r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()] for t in ("hot", "nobody")}
    assert [sum(r.kept for r in g) for g in groups.values()] == [1, 1]
    assert {(r.keep_id, r.group_size) for r in groups["hot"]} == {(7, 940)} and {(r.keep_id, r.group_size) for r in groups["nobody"]} == {(None, 900)}
    assert all(r.doc_id == 7 for r in groups["hot"] if r.kept)
    kept = [(r.doc_id, r.text) for r in keep_unique(spark, docs, "", tracked=512).collect()]
    assert len(kept) == 502 and (7, "hot") in kept and (None, "nobody") in kept


def test_stage_decides_by_row(spark):
    rows = [(1, "A", "x"), (5, "A", "y"), (5, "unique", "z"), (None, "A", "n"), (6, None, None), (7, "", "e"), (8, " ", "s"), (9, "same", "r"), (9, "same", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __k string")
    kept = keep_unique(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "A", "x"), (5, "unique", "z"), (6, None, None), (8, " ", "s"), (9, "same", "r")]
    assert keep_unique(spark, docs.limit(0), "").count() == 0

import hashlib
import random

import pytest

from tidalframe.llm.fill_middle import check_sentinels, draws, fill_in_middle, op11_fill_in_middle, restore, unit_offsets


def plainly(doc_id, text):
    """The contract, without the library: (n, form, prefix_chars, middle_chars, output)."""
    text, n = text or "", len(text or "")
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def odd_texts():
    rng = random.Random(11)
    letters = ["a", "é", " ", "  ", "\n", "\r\n", "日", "👩‍👧", "é", "\u0000", "‍", "<", "P>", "<S", ">", "<M>", "\U0001f1e9\U0001f1ea"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))) for _ in range(600)]


def test_equals_the_plain_rule_on_odd_texts(spark):
    texts = [None, "", " ", "  x ", "<P>", "<", "a" * 200_000, "é x " * 30_000, *odd_texts()]
    rows = [(i % 300 if i else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = restore(fill_in_middle(docs)).collect()
    assert sorted(((r.n, r.form, r.prefix_chars, r.middle_chars, r.fim_text) for r in got), key=repr) == sorted((plainly(*r) for r in rows), key=repr)
    assert all(r.restored == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_query_on_documents(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op11_fill_in_middle(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, form, prefix, middle, out = plainly(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_other_units_and_sentinels(spark):
    assert unit_offsets("ab, cd\nef", r"\w+").tolist() == [0, 2, 4, 6, 7, 9]
    docs = spark.createDataFrame([(i, "one two\nthree  four") for i in range(40)], "doc_id long, text string")
    marks = ("[pre]", "[suf]", "[mid]")
    got = restore(fill_in_middle(docs, unit=r"\w+", fim_percent=100, sentinels=marks), sentinels=marks).collect()
    assert {r.n for r in got} == {7} and all(r.restored == r.text and r.prefix_chars in (0, 3, 4, 7, 8, 13, 15, 19) for r in got)
    for bad in (("<P>", "<P>", "<M>"), ("ab", "ba", "x"), ("", "a", "b"), ("aa", "b", "c")):
        with pytest.raises(ValueError):
            check_sentinels(bad)


def test_clashing_columns_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "same text here", "x", 3), (1, "same text here", "y", 4)], "doc_id long, text string, form string, n int")
    a, b = fill_in_middle(docs).collect()
    assert a == b and fill_in_middle(docs).columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "fim_text"]
    assert fill_in_middle(docs.limit(0)).count() == 0
    assert draws("1", None) == draws("1", "") != draws("2", None)

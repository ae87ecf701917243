import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken

from tidalframe.llm.bpe import RANK_FILE, SegmentTree, _bpe, decode_ids, encode_texts, op8_bpe
from tidalframe.llm.common import read


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(RANK_FILE), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(3)
    fixed = ["", " ", "  ", "  x", "x  ", "x \n", "\n \n  x", "   a  b   c \n d\n \n e\t  f  ", "a" * 5000, "ab" * 3000, "é" * 300, "日本語 123 don't I'LL", "<|endoftext|> x"]
    return fixed + ["".join(rng.choice(" \n\tab'1é.ABCs  tion ") for _ in range(rng.randrange(1, 90))) for _ in range(2000)]


def test_ids_equal_the_library_and_decode_back():
    bpe, encode = _bpe(RANK_FILE)
    library, texts = reference(), odd_texts()
    for text, raw in zip(texts, encode(texts), strict=True):
        ids = np.frombuffer(raw, np.uint32)
        assert ids.tolist() == library.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_segment_tree_keeps_the_leftmost_minimum():
    rng = random.Random(1)
    values = [rng.randrange(50) * 100 + i for i in range(37)]
    tree = SegmentTree(values)
    for _ in range(300):
        i = rng.randrange(37)
        values[i] = rng.randrange(50) * 100 + i
        tree.put(i, values[i])
        assert tree.least == min(values)


def test_query_on_documents(spark, sf):
    library = reference()
    docs = {r.doc_id: r.text or "" for r in read(spark, sf, "documents").select("doc_id", "text").collect()}
    rows = op8_bpe(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_nulls_repeats_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "a b", "y"), (1, "a b", "y"), (None, "", "z")], "doc_id long, text string, token_ids string")
    rows = decode_ids(encode_texts(docs)).collect()
    assert sorted(bytes(r.decoded) for r in rows) == [b"", b"", b"a b", b"a b"]
    assert encode_texts(docs.limit(0)).count() == 0

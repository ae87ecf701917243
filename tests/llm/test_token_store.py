import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidalframe.llm.common import read
from tidalframe.llm.token_store import TOKENIZER_FILE, BucketIndex, MinimalPerfectHash, TokenStore, build_index, op2_token_store, write_store


def expected(rows):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(P.path(TOKENIZER_FILE))
    start, out = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_on_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in read(spark, sf, "documents").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in op2_token_store(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected(rows)


def test_keyed_access_and_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(-(2**62), 2**62), "".join(rng.choice("ab  c\n") for _ in range(rng.randrange(60)))) for _ in range(300)]
    rows += [(5, "twice"), (5, "twice"), (5, "other"), (None, "no id"), (6, None), (7, ""), (8, "<|endoftext|> long " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    written = write_store(docs, f"file://{tmp_path}/store", bucket_keys=50)
    direct = written.entries.where("direct").select("doc_id", "shard", "offset", "n_tokens")
    got = written.read_back(written.locate(docs).unionByName(direct)).collect()
    want = expected(rows)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    store = TokenStore(written.save_manifest())
    first = {}
    for key, _, n, crc in want:
        first.setdefault(key, (n, crc))
    for key, (n, crc) in first.items():
        if key is not None:
            ids = store[key]
            assert (len(ids), zlib.crc32(ids.astype("<u4").tobytes())) == (n, crc)
    for foreign in range(1000, 1400):
        with pytest.raises(KeyError):
            store[foreign]


def test_special_strings_are_encoded_as_the_library_does(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "  <|endoftext|>\n<|endoftext|> ", "<|endof text|>", "plain words " * 500 + "<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    written = write_store(docs)
    got = sorted(tuple(r) for r in written.read_back(written.locate(docs)).collect())
    assert got == expected(list(enumerate(texts)))
    assert TokenStore(written.save_manifest())[0].tolist() == [64, 220, 50256, 275, 0]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    written = write_store(docs)
    assert written.read_back(written.locate(docs)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70_000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.random.default_rng(n).integers(-(2**63), 2**63 - 1, n)
    keys = np.unique(keys)
    mph = MinimalPerfectHash.build(keys.view(np.uint64))
    assert sorted(mph.slots(keys.view(np.uint64)).tolist()) == list(range(len(keys)))
    index = BucketIndex(build_index(keys, keys & 7, np.arange(len(keys)), keys & 3))
    found, rows = index.find(keys)
    assert found.all() and (rows["offset"] == np.arange(len(keys))).all()
    assert not index.find(np.arange(10, 5000))[0].any()

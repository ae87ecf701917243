"""Operator 2: token-id shards with a minimal perfect hash index.

*Shards.* Documents are range-partitioned and sorted by id; each task encodes its rows with
the ``tokenizers`` library and streams one shard file: a 16-byte header, the raw ids of all
its documents (16 or 32 bits each, little-endian), every document ended by id 0. A task
that is run again writes another file, and only the files that the committed entry table
names belong to the store, so lost executors and speculative tasks leave it whole.

*Index.* Keys are dealt to buckets by hash (about ``bucket_keys`` each). A bucket's index is
a cascaded minimal perfect hash: at each level the keys that hash alone to a bit own it,
the others go on to the next level; the rank of the bit is the key's slot. A slot holds a
64-bit fingerprint, the shard, the offset and the number of ids. A lookup is one bucket,
a few bit probes and one slot, whatever the store's size; a foreign key fails its
fingerprint (a false match has probability 2^-64).

Files go through ``pyarrow.fs`` to the shared folder named in spark.checkpoint.dir (or to
``path``); tables through Spark.

Defined results: ids are the library's own, so a text that holds a special token's string has
that token's id there. Null text is empty (its record is the end id alone). Rows without an id,
and rows that repeat an id after the first (in order of id, then text), are stored in order
but not indexed: sequential reads return them, keyed access returns the first.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunked import ChunkEncoder
from .common import local_file, read, scratch_path, stage, text_of
from .textkernel import blocks, mix64

TOKENIZER_FILE = "byte_bpe_50k.json"
END_ID = 0
#: A shard's header: magic, bytes of an id, end id.
HEADER, HEADER_BYTES = "<8sII", 16
#: Bytes read from a shard at once when records are read in order.
READ_BYTES = 4 << 20
MAGIC, INDEX_MAGIC = b"TFTOKENS", b"TFTOKIDX"
_LEVEL = struct.Struct("<Q")
_PLAIN = re.compile(r" ?\S+")


@functools.lru_cache(maxsize=2)
def _library(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(local_file(name))
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def special(text: str) -> bool:
        """Whether the text holds a special token's string; its chunks would not show that."""
        return any(a in text for a in added)

    newline = tokenizer.encode("\n", add_special_tokens=False).ids

    def each(texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(texts: list[str]) -> list[bytes]:
        """Chunks without inner white space go as lines of one text: a line break between
        two of them is a token of its own, at which the ids are cut again."""
        out: list[bytes | None] = [None] * len(texts)
        plain = [k for k, t in enumerate(texts) if _PLAIN.fullmatch(t)] if len(newline) == 1 else []
        for lo in range(0, len(plain), 4096):
            part = plain[lo : lo + 4096]
            ids = np.frombuffer(each(["\n".join(texts[k] for k in part)])[0], np.uint32)
            cut = np.flatnonzero(ids == newline[0])
            if len(cut) != len(part) - 1:
                continue
            raw, bounds = ids.tobytes(), [-1, *cut.tolist(), len(ids)]
            for k, a, b in zip(part, bounds[:-1], bounds[1:], strict=True):
                out[k] = raw[4 * a + 4 : 4 * b]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, each([texts[k] for k in rest]), strict=True):
            out[k] = x
        return out

    return ChunkEncoder(encode, whole=special, encode_whole=each), tokenizer.get_vocab_size()


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


# --- minimal perfect hash ---------------------------------------------------------------


class MinimalPerfectHash:
    """Cascade of bit arrays over distinct 64-bit keys; slot = rank of the key's bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for words in levels:
            counts = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(base + np.cumsum(counts) - counts)
            base += int(counts.sum())
        self.size = base

    @staticmethod
    def _bit(keys: np.ndarray, level: int, n_words: int) -> np.ndarray:
        return mix64(keys ^ np.uint64(0xA24BAED4963EE407 * (level + 1) & (2**64 - 1))) % np.uint64(64 * n_words)

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        levels = []
        while len(keys):
            n_words = max(1, -(-2 * len(keys) // 64))
            bit = cls._bit(keys, len(levels), n_words).astype(np.int64)
            alone = np.bincount(bit, minlength=64 * n_words) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys = keys[~alone[bit]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level has its bit (surely a foreign key)."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(open_):
                break
            bit = self._bit(keys[open_], level, len(words))
            word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            held = words[word] >> shift & np.uint64(1) == 1
            below = words[word] & ((np.uint64(1) << shift) - np.uint64(1))
            out[open_[held]] = (ranks[word] + np.bitwise_count(below).astype(np.int64))[held]
            open_ = open_[~held]
        return out

    def to_bytes(self) -> bytes:
        return b"".join([_LEVEL.pack(len(self.levels)), *[_LEVEL.pack(len(x)) + x.tobytes() for x in self.levels]])

    @classmethod
    def from_bytes(cls, raw: bytes, at: int = 0) -> tuple[MinimalPerfectHash, int]:
        (n,), at = _LEVEL.unpack_from(raw, at), at + 8
        levels = []
        for _ in range(n):
            (size,), at = _LEVEL.unpack_from(raw, at), at + 8
            levels.append(np.frombuffer(raw, np.uint64, size, at))
            at += 8 * size
        return cls(levels), at


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return mix64(keys * np.uint64(0xE7037ED1A0B428DB) + np.uint64(0x8EBC6AF09C88C6E3))


_SLOT = np.dtype([("print", "<u8"), ("shard", "<u8"), ("offset", "<u8"), ("n", "<u8")])


def build_index(keys: np.ndarray, shard: np.ndarray, offset: np.ndarray, n: np.ndarray) -> bytes:
    """Bytes of one bucket's index over distinct int64 keys."""
    keys = keys.astype(np.int64).view(np.uint64)
    mph = MinimalPerfectHash.build(keys)
    slots = np.empty(len(keys), _SLOT)
    at = mph.slots(keys)
    for name, column in (("print", fingerprints(keys)), ("shard", shard), ("offset", offset), ("n", n)):
        slots[name][at] = column
    return INDEX_MAGIC + mph.to_bytes() + slots.tobytes()


class BucketIndex:
    """A bucket's index, looked up by key."""

    def __init__(self, raw: bytes):
        if raw[:8] != INDEX_MAGIC:
            raise ValueError("not a token index")
        self.mph, at = MinimalPerfectHash.from_bytes(raw, 8)
        self.table = np.frombuffer(raw, _SLOT, self.mph.size, at)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, slots) of int64 keys; a slot counts only where found."""
        keys = keys.astype(np.int64).view(np.uint64)
        at = self.mph.slots(keys)
        rows = self.table[np.maximum(at, 0)] if self.mph.size else np.zeros(len(keys), _SLOT)
        return (at >= 0) & (rows["print"] == fingerprints(keys)), rows


# --- writing ------------------------------------------------------------------------------


def bucket_of(key: F.Column, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def _bucket_of(key: int, buckets: int) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
    return (h - (1 << 64) if h >> 63 else h) % buckets


def write_shards(docs: DataFrame, path: str, tokenizer_file: str = TOKENIZER_FILE, end_id: int = END_ID) -> DataFrame:
    """Write shards under ``path``; one entry a document, in the committed table returned.

    Entries: shard, file, record, doc_id, offset, n_tokens, direct (not in the index).
    """

    def run(batches):
        encode, vocabulary = _library(tokenizer_file)
        dtype = np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")
        end = np.array([end_id], np.uint32).tobytes()
        store, folder = _open(path)
        shard, out, file = TaskContext.get().partitionId(), None, ""
        offset = record = 0
        last = None
        for batch in batches:
            if out is None and batch.num_rows:
                file = f"shard-{shard:06d}-{uuid.uuid4().hex}.ids"
                store.create_dir(folder, recursive=True)
                out = store.open_output_stream(f"{folder}/{file}")
                out.write(struct.pack(HEADER, MAGIC, dtype.itemsize, end_id))
            for block in blocks(batch.column(1)):
                ids = [x + end for x in encode([block.text(i).decode() for i in range(block.n_docs)])]
                out.write(np.frombuffer(b"".join(ids), np.uint32).astype(dtype).tobytes())
                sizes = np.array([len(x) >> 2 for x in ids], np.int64)
                keys = batch.column(0).slice(block.first, block.n_docs)
                direct = []
                for key in keys.to_pylist():
                    direct.append(key is None or key == last)
                    last = key
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": np.full(block.n_docs, shard, np.int64),
                        "file": [file] * block.n_docs,
                        "record": np.arange(record, record + block.n_docs),
                        "doc_id": keys,
                        "offset": offset + np.cumsum(sizes) - sizes,
                        "n_tokens": sizes,
                        "direct": direct,
                    }
                )
                offset += int(sizes.sum())
                record += block.n_docs
        if out is not None:
            out.close()

    schema = "shard long, file string, record long, doc_id long, offset long, n_tokens long, direct boolean"
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stage(ordered.mapInArrow(run, schema), "token-entries")


def write_index(entries: DataFrame, path: str, bucket_keys: int = 1 << 16) -> tuple[DataFrame, int]:
    """Index the entries by key; (bucket, index_file) table and the number of buckets."""
    keyed = entries.where("not direct")
    buckets = max(1, -(-keyed.count() // bucket_keys))

    def build(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        column = lambda name: table.column(name).to_numpy()
        file = f"index-{bucket:06d}-{uuid.uuid4().hex}.mph"
        store, folder = _open(path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{file}") as out:
            out.write(build_index(column("doc_id"), column("shard"), column("offset"), column("n_tokens")))
        return pa.table({"bucket": [bucket], "index_file": [file]})

    rows = keyed.select(bucket_of(F.col("doc_id"), buckets).alias("bucket"), "doc_id", "shard", "offset", "n_tokens")
    built = rows.groupBy("bucket").applyInArrow(build, "bucket long, index_file string")
    return stage(built, "token-index"), buckets


class Written:
    """A store as the writing job knows it: its folder, entries, index files, shard files."""

    def __init__(self, spark: SparkSession, path: str, entries: DataFrame, index: DataFrame, buckets: int):
        self.spark, self.path, self.entries, self.index, self.buckets = spark, path, entries, index, buckets
        order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        # One row a shard: as many as tasks wrote, never as many as documents.
        totals = entries.groupBy("shard", "file").agg(F.sum("n_tokens").alias("shard_ids"))
        self.shards = totals.withColumn("base", F.coalesce(F.sum("shard_ids").over(order), F.lit(0).cast("long")))

    def save_manifest(self) -> str:
        """Write manifest.json, with which :class:`TokenStore` opens the store without Spark."""
        store, folder = _open(self.path)
        body = {
            "buckets": self.buckets,
            "index": {r.bucket: r.index_file for r in self.index.toLocalIterator()},
            "shards": {r.shard: [r.file, r.base] for r in self.shards.toLocalIterator()},
        }
        with store.open_output_stream(f"{folder}/manifest.json") as out:
            out.write(json.dumps(body).encode())
        return self.path

    def locate(self, keys: DataFrame) -> DataFrame:
        """(doc_id, shard, offset, n_tokens) of the distinct ids, through the index."""
        path = self.path

        def find(table: pa.Table) -> pa.Table:
            store, folder = _open(path)
            with store.open_input_file(f"{folder}/{table.column('index_file')[0].as_py()}") as file:
                index = BucketIndex(file.read())
            ids = table.column("doc_id").to_numpy()
            found, rows = index.find(ids)
            get = lambda name: rows[name][found].astype(np.int64)
            return pa.table({"doc_id": ids[found], "shard": get("shard"), "offset": get("offset"), "n_tokens": get("n")})

        dealt = keys.select("doc_id").where("doc_id is not null").distinct().withColumn("bucket", bucket_of(F.col("doc_id"), self.buckets))
        dealt = dealt.join(self.index, "bucket")
        return dealt.groupBy("bucket").applyInArrow(find, "doc_id long, shard long, offset long, n_tokens long")

    def read_back(self, located: DataFrame) -> DataFrame:
        """Read located records from the shard files: doc_id, start, n_tokens, ids_crc32."""
        path = self.path

        def crc(batches):
            store, folder = _open(path)
            name, file, kind, held, at = None, None, None, b"", 0
            for batch in batches:
                sums = []
                for want, offset, n in zip(batch.column("file").to_pylist(), batch.column("offset").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
                    if want != name:
                        if file is not None:
                            file.close()
                        name, file = want, store.open_input_file(f"{folder}/{want}")
                        magic, size, _ = struct.unpack(HEADER, file.read_at(HEADER_BYTES, 0))
                        if magic != MAGIC:
                            raise ValueError(f"{want} is not a shard")
                        kind, held = np.dtype(f"<u{size}"), b""
                    # Records come in order of place, so a read serves those that follow too.
                    lo = HEADER_BYTES + offset * kind.itemsize
                    hi = lo + n * kind.itemsize
                    if lo < at or hi > at + len(held):
                        held, at = file.read_at(max(hi - lo, READ_BYTES), lo), lo
                    ids = np.frombuffer(held[lo - at : hi - at], kind)
                    if len(ids) != n:
                        raise ValueError(f"{want} is shorter than its index says")
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        rows = located.join(self.shards.select("shard", "file", "base"), "shard")
        rows = rows.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "file", "shard", "offset")
        # Range by place keeps reads of a shard together and in order, and splits large ones.
        rows = rows.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
        return rows.mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_store(docs: DataFrame, path: str | None = None, tokenizer_file: str = TOKENIZER_FILE, end_id: int = END_ID, bucket_keys: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> Written:
    """Encode and write ``docs``; without ``path`` into the session's scratch folder."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    entries = write_shards(rows, path, tokenizer_file, end_id)
    index, buckets = write_index(entries, path, bucket_keys)
    return Written(spark, path, entries, index, buckets)


class TokenStore:
    """Keyed access to a saved store, without Spark: two small reads and the ids."""

    def __init__(self, path: str):
        self.store, self.folder = _open(path)
        with self.store.open_input_stream(f"{self.folder}/manifest.json") as file:
            self.manifest = json.loads(file.read())
        self._buckets: dict[int, BucketIndex] = {}

    def __getitem__(self, key: int) -> np.ndarray:
        bucket = _bucket_of(key, self.manifest["buckets"])
        if bucket not in self._buckets:
            name = self.manifest["index"].get(str(bucket))
            if name is None:
                raise KeyError(key)
            with self.store.open_input_file(f"{self.folder}/{name}") as file:
                self._buckets[bucket] = BucketIndex(file.read())
        found, rows = self._buckets[bucket].find(np.array([key], np.int64))
        if not found[0]:
            raise KeyError(key)
        name, _ = self.manifest["shards"][str(int(rows["shard"][0]))]
        with self.store.open_input_file(f"{self.folder}/{name}") as file:
            _, size, _ = struct.unpack(HEADER, file.read_at(HEADER_BYTES, 0))
            kind = np.dtype(f"<u{size}")
            return np.frombuffer(file.read_at(int(rows["n"][0]) * size, HEADER_BYTES + int(rows["offset"][0]) * size), kind)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    written = write_store(docs)
    located = written.locate(docs.select(F.col("doc_id").cast("long").alias("doc_id")))
    direct = written.entries.where("direct").select("doc_id", "shard", "offset", "n_tokens")
    return written.read_back(located.unionByName(direct))

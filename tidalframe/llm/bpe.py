"""Operator 8: byte-level BPE encoding and decoding with a segment tree of pair ranks.

Each match of the split pattern is a piece. A segment tree over the piece's byte positions
holds, at position i, the rank of merging the token that starts at i with its right
neighbour; inner nodes hold the smallest (rank, position), so the root is the leftmost
minimum. A merge takes the root, joins the token with its neighbour, and updates the three
leaves it touches (the merged token, its left neighbour, the absorbed position) with
logarithmic walks to the root. Pieces of up to 64 bytes are handled as lanes of NumPy
arrays, thousands at a time; longer ones run the same tree alone, in O(n log n).

The rank file is read by its path on each worker. Encoding of repeated chunks is memoised
(:mod:`chunked`), which changes no result.

Defined results: null and empty texts have no ids and decode to no bytes; ids outside the
vocabulary raise. Added columns replace columns of that name.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunked import ChunkEncoder
from .common import local_file, read
from .textkernel import blocks

RANK_FILE = "byte_bpe_50k.tiktoken"
_NONE = np.int64(1) << 62
_LANE_BYTES = 64


class SegmentTree:
    """Leftmost minimum over a fixed number of positions, with point updates."""

    def __init__(self, values: list[int]):
        self.size = 1 << max(0, (len(values) - 1).bit_length())
        none = int(_NONE)
        self.node = [none] * (2 * self.size)
        for i, v in enumerate(values):
            self.node[self.size + i] = v
        for i in range(self.size - 1, 0, -1):
            self.node[i] = min(self.node[2 * i], self.node[2 * i + 1])

    def put(self, position: int, value: int) -> None:
        node, i = self.node, position + self.size
        node[i] = value
        i >>= 1
        while i:
            low = node[2 * i] if node[2 * i] <= node[2 * i + 1] else node[2 * i + 1]
            if node[i] == low:
                break
            node[i] = low
            i >>= 1

    @property
    def least(self) -> int:
        return self.node[1]


class RankedBpe:
    """Merges by rank, as the rank file's own library does them."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.split = regex.compile(pattern)
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.token[rank] = token
        self.base = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 24 | right] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.pairs = pairs
        lengths = np.array([len(t) for t in self.token], np.int64)
        self.token_first = np.concatenate([[0], np.cumsum(lengths)])
        self.token_bytes = np.frombuffer(b"".join(self.token), np.uint8)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of joining two tokens, ``_NONE`` where the vocabulary has no such token."""
        keys = left << 24 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE)

    def merge_lanes(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Merge pieces of at most ``width`` bytes (a power of two) side by side."""
        n = len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        spot = np.arange(width)
        token = self.base[raw]
        # Tree of width leaves as one row of 2 * width nodes; a node holds rank * width + position.
        tree = np.full((n, 2 * width), _NONE)
        rank = self.pair_rank(token[:, :-1], token[:, 1:])
        real = (spot[None, 1:] < lengths[:, None]) & (rank < _NONE)
        tree[:, width : 2 * width - 1] = np.where(real, rank * width + spot[:-1], _NONE)
        level = width
        while level > 1:
            level >>= 1
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        after = np.broadcast_to(spot + 1, (n, width)).copy()
        before = np.broadcast_to(spot - 1, (n, width)).copy()
        alive = spot[None, :] < lengths[:, None]
        lane = np.flatnonzero(tree[:, 1] < _NONE)
        while len(lane):
            least = tree[lane, 1]
            merged, at = least // width, least % width
            gone = after[lane, at]
            right = after[lane, gone]
            left = before[lane, at]
            token[lane, at] = merged
            alive[lane, gone] = False
            after[lane, at] = right
            has_right, has_left = right < lengths[lane], left >= 0
            r, l = np.where(has_right, right, at), np.where(has_left, left, at)
            before[lane[has_right], right[has_right]] = at[has_right]
            tree[lane, width + gone] = _NONE
            joined = self.pair_rank(merged, token[lane, r])
            tree[lane, width + at] = np.where(has_right & (joined < _NONE), joined * width + at, _NONE)
            joined = self.pair_rank(token[lane, l], merged)
            value = np.where(joined < _NONE, joined * width + l, _NONE)
            tree[lane[has_left], width + l[has_left]] = value[has_left]
            for position in (gone, at, l):
                node = (position + width) >> 1
                while node[0]:
                    tree[lane, node] = np.minimum(tree[lane, 2 * node], tree[lane, 2 * node + 1])
                    node = node >> 1
            lane = lane[tree[lane, 1] < _NONE]
        flat = token[alive]
        return np.split(flat, np.cumsum(alive.sum(1))[:-1])

    def merge_alone(self, piece: bytes) -> list[int]:
        """Merge one piece of any length."""
        n, none, pairs = len(piece), int(_NONE), self.pairs
        token = self.base[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def value(i: int, j: int) -> int:
            rank = pairs.get(token[i] << 24 | token[j]) if 0 <= i and j < n else None
            return none if rank is None else rank * n + i

        tree = SegmentTree([value(i, i + 1) for i in range(n)])
        alive = bytearray(b"\1" * n)
        while tree.least < none:
            rank, at = divmod(tree.least, n)
            gone = after[at]
            token[at], alive[gone], after[at] = rank, 0, after[gone]
            if after[at] < n:
                before[after[at]] = at
            tree.put(gone, none)
            tree.put(at, value(at, after[at]))
            if before[at] >= 0:
                tree.put(before[at], value(before[at], at))
        return [t for t, a in zip(token, alive, strict=True) if a]

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids (unsigned 32-bit) of each distinct piece."""
        out: dict[bytes, bytes] = {}
        by_width: dict[int, list[bytes]] = {}
        for piece in set(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[piece] = np.uint32(rank).tobytes()
            elif len(piece) <= _LANE_BYTES:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(piece)
            else:
                out[piece] = np.array(self.merge_alone(piece), np.uint32).tobytes()
        for width, group in by_width.items():
            for lo in range(0, len(group), 8192):
                part = group[lo : lo + 8192]
                for piece, ids in zip(part, self.merge_lanes(part, width), strict=True):
                    out[piece] = ids.astype(np.uint32).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes of unsigned 32-bit integers."""
        rows = [[p.encode() for p in self.split.findall(t)] for t in texts]
        ids = self.encode_pieces([p for row in rows for p in row])
        return [b"".join(map(ids.__getitem__, row)) for row in rows]

    def decode(self, ids: np.ndarray) -> bytes:
        """Concatenated token bytes of the ids."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.token):
            raise ValueError("an id lies outside the vocabulary")
        first, size = self.token_first[ids], self.token_first[ids + 1] - self.token_first[ids]
        end = np.cumsum(size)
        return self.token_bytes[np.arange(end[-1]) + np.repeat(first - (end - size), size)].tobytes()


#: Chunks that a worker remembers, about 130 bytes each; as many encoded afresh when it is emptied.
MEMO = 500_000


@functools.lru_cache(maxsize=2)
def _bpe(name: str) -> tuple[RankedBpe, ChunkEncoder]:
    import public_tokenizers

    bpe = RankedBpe(local_file(name), public_tokenizers.PATTERN)
    return bpe, ChunkEncoder(bpe.encode, limit=MEMO)


def _encoded(column: pa.Array, rank_file: str):
    """Per block: (rows, ids as an Arrow list array)."""
    _, encode = _bpe(rank_file)
    for block in blocks(column):
        got = encode([block.text(i).decode() for i in range(block.n_docs)])
        bounds = np.zeros(block.n_docs + 1, np.int32)
        bounds[1:] = np.cumsum([len(x) >> 2 for x in got])
        ids = pa.array(np.frombuffer(b"".join(got), np.uint32).astype(np.int32), pa.int32())
        yield block, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), ids)


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode_texts(docs: DataFrame, text_col: str = "text", out_col: str = "token_ids", rank_file: str = RANK_FILE, decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the ids of the texts (array<int>).

    With ``decoded_col`` the ids are also decoded in the same pass, to binary.
    """
    docs = docs.drop(out_col, *([decoded_col] if decoded_col else []))
    at = docs.columns.index(text_col)
    schema = _with(docs.schema, out_col, T.ArrayType(T.IntegerType()))
    if decoded_col:
        schema = _with(schema, decoded_col, T.BinaryType())

    def run(batches):
        bpe, _ = _bpe(rank_file)
        for batch in batches:
            for block, ids in _encoded(batch.column(at), rank_file):
                columns = [*batch.slice(block.first, block.n_docs).columns, ids]
                if decoded_col:
                    bounds, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
                    columns.append(pa.array([bpe.decode(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def decode_ids(table: DataFrame, ids_col: str = "token_ids", out_col: str = "decoded", rank_file: str = RANK_FILE) -> DataFrame:
    """``table`` with the bytes that the ids stand for (null ids: none)."""
    table = table.drop(out_col)
    at = table.columns.index(ids_col)
    schema = _with(table.schema, out_col, T.BinaryType())

    def run(batches):
        bpe, _ = _bpe(rank_file)
        for batch in batches:
            decoded = pa.array([bpe.decode(np.array(x or [], np.int64)) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=schema.names)

    return table.mapInArrow(run, schema)


def digest_columns(encoded: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of encoded documents."""
    listed = F.array_join(F.transform("token_ids", lambda x: x.cast("string")), " ")
    return encoded.withColumns(
        {
            "n_tokens": F.size("token_ids").cast("long"),
            "ids_sha256": F.sha2(listed.cast("binary"), 256),
            "decoded_sha256": F.sha2("decoded", 256),
        }
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_texts(docs, decoded_col="decoded")
    return digest_columns(encoded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def tokenize_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document with its ids, and the digests of ids and bytes, for its text.

    Row by row: null or repeated ids change nothing, null and empty texts have no ids; an empty
    table gives an empty result.
    """
    encoded = digest_columns(encode_texts(docs, decoded_col="decoded"))
    return encoded.drop("text", "decoded")

"""Vectorised byte kernels over Arrow string columns.

Whole batches of texts are handled as one UTF-8 byte array: word boundaries, word
hashes and n-gram hashes cost a few NumPy passes and no Python object per word.
Batches are cut into blocks of about ``BLOCK`` bytes (never inside a document), so a
worker holds about 60 bytes for each byte of a block or of the longest single text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD_STEP = np.uint64(0xD6E8FEB86659FD93)


def _byte_class(member) -> np.ndarray:
    return np.fromiter((member(b) for b in range(256)), bool, 256)


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z: digits, a-z, all non-ASCII.
ALNUM = _byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
#: Everything but ``[\x20\x09-\x0D]``.
NON_SPACE = _byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, BLOCK + 1)
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Block:
    """Rows ``first:last`` of a batch with their bytes and document offsets."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n_docs(self) -> int:
        return self.last - self.first

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    size = kind().itemsize
    offs = np.frombuffer(offsets, kind, len(column) + 1, column.offset * size).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[Block]:
    """Cut a string column into blocks of whole documents of about ``size`` bytes."""
    data, offsets = string_bytes(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(n, max(to, at + 1))
        yield Block(at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


@dataclass
class Words:
    """Word spans of a block: byte bounds, hashes, and each document's word range."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc_first: np.ndarray
    folded: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        counts = np.diff(self.doc_first)
        return np.repeat(np.arange(len(counts)), counts)

    def joined(self, lo: int, hi: int) -> bytes:
        """Words ``lo:hi`` joined by one space."""
        raw = self.folded
        return b" ".join(raw[s:e].tobytes() for s, e in zip(self.start[lo:hi], self.end[lo:hi], strict=True))


def words(block: Block, member: np.ndarray, hasher=None) -> Words:
    """ASCII-lower-cased words (maximal runs of ``member`` bytes) and their hashes: by ``hasher``
    of (bytes, starts, ends), else the fast polynomial, where equal hashes are checked on words."""
    folded = _LOWER[block.data]
    n = len(folded)
    if n == 0:
        none = np.empty(0, np.int64)
        return Words(none, none, np.empty(0, np.uint64), np.zeros(block.n_docs + 1, np.int64), folded)
    inside = member[folded]
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:])
    cuts = block.offsets[:-1]
    edge[cuts[cuts < n]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], n)
    hold = inside[starts]
    start, end = starts[hold], ends[hold]
    if hasher is not None:
        return Words(start, end, hasher(folded, start, end), np.searchsorted(start, block.offsets), folded)
    up, down = _power_tables(n + 1)
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    hashed = mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(start, end, hashed, np.searchsorted(start, block.offsets), folded)


#: Bytes of a word that ``lane_hashes`` takes in lanes; longer words are hashed one by one.
LANE_BYTES = 256
_KEY = b"tidalframe words"


def lane_hashes(folded: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words in which nothing is linear: 8-byte lanes, each mixed into the state
    by two multiplications and shifts, after the length; long words by keyed BLAKE2b."""
    padded = np.concatenate([folded, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(folded) + 1,), "<u8", padded, strides=(1,))
    size = end - start
    order = np.argsort(-size, kind="stable")
    at, falling = start[order], -size[order]
    state = mix64((-falling).astype(np.uint64) + _BASE)
    longest = int(np.searchsorted(falling, -LANE_BYTES, "left"))
    for done in range(0, min(LANE_BYTES, int(-falling[0]) if len(falling) else 0), 8):
        n = int(np.searchsorted(falling, -done, "left"))  # words of more than ``done`` bytes
        left = np.minimum(-falling[:n] - done, 8).astype(np.uint64)
        lane = lanes[at[:n] + done] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        state[:n] = mix64((state[:n] ^ mix64(lane * _BASE)) * _WORD_STEP + lane)
    for i in range(longest):
        word = folded[at[i] : at[i] - falling[i]].tobytes()
        state[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=_KEY).digest(), "little")
    out = np.empty_like(state)
    out[order] = state
    return out


def gram_hashes(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words (runs may cross documents)."""
    count = len(word_hash) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = word_hash[:count].copy()
    for j in range(1, n):
        out *= _WORD_STEP
        out += word_hash[j : j + count]
    return mix64(out)


def whole_hash(word_hash: np.ndarray) -> np.uint64:
    """Hash of a whole sequence, equal to ``gram_hashes`` of that length."""
    return gram_hashes(word_hash, len(word_hash))[0]


def inside_document(doc_first: np.ndarray, n: int) -> np.ndarray:
    """Word positions at which a run of ``n`` words stays within one document."""
    total = int(doc_first[-1])
    ok = np.ones(max(total - n + 1, 0), bool)
    for back in range(1, n):
        at = doc_first[1:-1] - back
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    return np.flatnonzero(ok)

"""Exact memo of the encoding of space-separated chunks, shared by the tokenizing operators.

With the byte-level pattern a text may be cut before a space: what follows is split the
same way whatever stands before, unless that space has white space on both sides (or on
its left and the end on its right). Texts without such a space are encoded as the
concatenation of their chunks, the others, and those that ``whole`` names, as a whole. Each distinct chunk is encoded once
in a worker while the memo holds it; the memo is emptied when it reaches ``limit``
entries, so its memory is bounded and results do not depend on it. Encodings that may be cut
before any space say so with ``joined=False``.
"""

from __future__ import annotations

import re
import weakref
from collections.abc import Callable

import pyarrow as pa

_JOINED_RUN = re.compile(r"\s (?:\s|$)")


#: The encoders of this worker.
_LIVE: weakref.WeakSet[ChunkEncoder] = weakref.WeakSet()


def forget() -> None:
    """Empty the memos of this worker, which lives on after the stage that filled them."""
    for encoder in list(_LIVE):
        encoder.forget()
    pa.default_memory_pool().release_unused()


class ChunkEncoder:
    """Encode texts to ids (bytes of unsigned 32-bit integers) through a chunk memo."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 900_000, memo_chars: int = 64, whole: Callable[[str], bool] = lambda text: False, encode_whole: Callable[[list[str]], list[bytes]] | None = None, joined: bool = True):
        self._encode, self._limit, self._memo_chars = encode, limit, memo_chars
        self._whole, self._encode_whole = whole, encode_whole or encode
        self._joined = joined
        self._memo: dict[str, bytes] = {}
        _LIVE.add(self)

    def forget(self) -> None:
        self._memo = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self._memo) > self._limit:
            self._memo = {}
        memo = self._memo
        rows: list[list[str] | None] = []
        unknown: set[str] = set()
        whole: list[int] = []
        for k, text in enumerate(texts):
            if self._joined and _JOINED_RUN.search(text) or self._whole(text):
                rows.append(None)
                whole.append(k)
                continue
            first, *rest = text.split(" ")
            chunks = [first, *[" " + c for c in rest]]
            rows.append(chunks)
            unknown.update(chunks)
        unknown = {c for c in unknown if c not in memo}
        fresh = list(unknown)
        known = dict(zip(fresh, self._encode(fresh), strict=True))
        alone = dict(zip(whole, self._encode_whole([texts[k] for k in whole]), strict=True))
        memo.update((c, v) for c, v in known.items() if len(c) <= self._memo_chars)
        long = {c: v for c, v in known.items() if len(c) > self._memo_chars}
        get = memo.__getitem__ if not long else lambda c: memo[c] if c in memo else long[c]
        return [alone[k] if row is None else b"".join(map(get, row)) for k, row in enumerate(rows)]

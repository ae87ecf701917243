"""Operator 3: benchmark decontamination with a broadcast hash set of test n-grams.

Benchmark items are normalised (A-Z lower-cased, words of digits, letters and non-ASCII)
and cut into windows of ``n`` words; an item of fewer words is one window. What is broadcast
is one sorted array of window hashes for each length, the items' words once, and the place
of each window in them: about 60 bytes a window, and no object for each. Documents are
scanned once, whole, in NumPy blocks straight from Arrow buffers: every window of every
length in the set is hashed, looked up, and each hit is verified on its words.

A benchmark of more than ``block_bytes`` of text is dealt into blocks of about that size by
item. One block is collected, broadcast and scanned for at a time: the hit runs of a block are
staged before the next is read, so neither driver nor worker ever holds two. The usual
benchmark is one block, and documents are neither joined nor shuffled.

As a stage (``drop_contaminated``): contaminated documents go, all others stay as they are, rows
with null or repeated ids and null texts too.

Defined results: null and empty texts have no words and are clean; null items and items
without words match nothing; repeated items all count; null item ids are left out of
``item_ids`` but their windows still hit. Added columns replace columns of that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, stage
from .textkernel import ALNUM, Block, blocks, gram_hashes, inside_document, string_bytes, whole_hash, words

ADDED = ("n_words", "hit_runs", "item_ids")
_SCAN_TYPES = {
    "n_words": T.LongType(),
    "hit_runs": T.ArrayType(T.LongType()),
    "item_ids": T.ArrayType(T.LongType()),
}


class WindowSet:
    """Hash set of normalised windows of one benchmark block, by window length.

    A class is a distinct window; ``first`` and ``items`` list the items that hold it.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], n: int):
        data, offsets = string_bytes(pa.array([t for _, t in items], pa.large_string()))
        w = words(Block(0, len(items), data, offsets), ALNUM)
        ids = np.array([-1 if i is None else i for i, _ in items], np.int64)
        known = np.array([i is not None for i, _ in items], bool)
        self.text, self.at = joined_words(w)
        counts = np.diff(w.doc_first)
        self.sizes: dict[int, tuple] = {}
        for size in sorted({min(n, int(c)) for c in counts} - {0}):
            if size == n:
                place = inside_document(w.doc_first, n)
                hashed = gram_hashes(w.hash, n)[place]
            else:
                place = w.doc_first[:-1][counts == size]
                hashed = np.array([whole_hash(w.hash[i : i + size]) for i in place], np.uint64)
            self.sizes[size] = self._classes(size, place, hashed, np.searchsorted(w.doc_first, place, "right") - 1, ids, known)

    def _classes(self, size: int, place: np.ndarray, hashed: np.ndarray, item: np.ndarray, ids: np.ndarray, known: np.ndarray) -> tuple:
        order = np.lexsort((item, hashed))
        place, hashed, item = place[order], hashed[order], item[order]
        new = np.ones(len(place), bool)
        new[1:] = hashed[1:] != hashed[:-1]
        # Equal hashes of unequal words part a class; they are rare, equal windows are not.
        for k in np.flatnonzero(~new).tolist():
            new[k] = self.window(place[k], size) != self.window(place[k - 1], size)
        first = np.flatnonzero(new)
        kept = np.cumsum(np.append(0, known[item]))
        hashes = hashed[first]
        return hashes, place[first], kept[np.append(first, len(place))], ids[item[known[item]]], *self._bitmap(hashes)

    @staticmethod
    def _bitmap(found: np.ndarray) -> tuple[np.uint64, np.ndarray]:
        bits = max(16, int(len(found) * 8).bit_length())
        shift = np.uint64(64 - bits)
        present = np.zeros(1 << bits, bool)
        present[(found >> shift).astype(np.int64)] = True
        return shift, present

    def window(self, word: int, size: int) -> bytes:
        """The words from one on, joined by a space."""
        return self.text[self.at[word] : self.at[word + size] - 1].tobytes()

    def hits(self, w) -> Iterator[tuple[int, int, int]]:
        """(first word, words, class) of each verified window occurrence."""
        for size, (known, place, _, _, shift, present) in self.sizes.items():
            grams = gram_hashes(w.hash, size)
            if not len(grams):
                continue
            at = np.flatnonzero(present[(grams >> shift).astype(np.int64)])
            if not len(at):
                continue
            near = np.searchsorted(known, grams[at])
            held = known[np.minimum(near, len(known) - 1)] == grams[at]
            at, near = at[held], near[held]
            inside = at + size <= w.doc_first[np.searchsorted(w.doc_first, at, "right")]
            for i, k in zip(at[inside].tolist(), near[inside].tolist(), strict=True):
                found, h = w.joined(i, i + size), known[k]
                while k < len(known) and known[k] == h:
                    if self.window(place[k], size) == found:
                        yield i, size, k
                    k += 1

    def items(self, classes: set[tuple[int, int]]) -> list[int]:
        """Ids, in order, of the items that hold one of the (size, class) windows."""
        out: set[int] = set()
        for size, k in classes:
            _, _, bound, ids, *_ = self.sizes[size]
            out.update(ids[bound[k] : bound[k + 1]].tolist())
        return sorted(out)


def joined_words(w) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all words with a space after each, where each word begins, and the end)."""
    size = w.end - w.start
    at = np.append(0, np.cumsum(size + 1))
    text = np.full(at[-1], 32, np.uint8)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(at[:-1], size) + within] = w.folded[np.repeat(w.start, size) + within]
    return text, at


def _scan(column: pa.Array, windows: WindowSet) -> Iterator[tuple[list[int], list[list[int]], list[list[int]]]]:
    """Per block: words, flattened hit runs (word bounds in the document), item ids."""
    for block in blocks(column):
        w = words(block, ALNUM)
        counts = np.diff(w.doc_first).tolist()
        runs: list[list[int]] = [[] for _ in counts]
        classes: list[set[tuple[int, int]]] = [set() for _ in counts]
        marks: dict[int, list[tuple[int, int]]] = {}
        for i, size, k in windows.hits(w):
            d = int(np.searchsorted(w.doc_first, i, "right")) - 1
            base = int(w.doc_first[d])
            marks.setdefault(d, []).append((i - base, i - base + size))
            classes[d].add((size, k))
        for d, spans in marks.items():
            runs[d] = merge_runs(spans)
        yield counts, runs, [windows.items(x) for x in classes]


def merge_runs(spans: list[tuple[int, int]]) -> list[int]:
    """Union of half-open spans as a flat ascending list start, end, start, end."""
    out: list[int] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += [lo, hi]
    return out


def _pairs(flat: list[int]) -> list[tuple[int, int]]:
    return list(zip(flat[::2], flat[1::2], strict=True))


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark's distinct rows (i, t) in blocks of about ``block_bytes`` of text."""
    items = benchmark.select(benchmark[item_col].cast("long").alias("i"), benchmark[text_col].cast("string").alias("t")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // block_bytes))
    return [items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == k) for k in range(n_blocks)]


def mark_block(out: DataFrame, at: int, windows: Broadcast) -> DataFrame:
    """One scan of ``out`` (text at column ``at``, last the added columns) for a block's windows."""
    n = len(out.columns)

    def scan(batches):
        for batch in batches:
            done = 0
            for counts, runs, ids in _scan(batch.column(at), windows.value):
                part = batch.slice(done, len(counts))
                done += len(counts)
                before, ids_before = part.column(n - 2).to_pylist(), part.column(n - 1).to_pylist()
                runs = [merge_runs(_pairs(x) + _pairs(b or [])) for x, b in zip(runs, before, strict=True)]
                ids = [sorted({*x, *(b or [])}) for x, b in zip(ids, ids_before, strict=True)]
                columns = part.columns[:-3] + [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return out.mapInArrow(scan, out.schema)


def mark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """``docs`` with n_words, hit_runs (flat word bounds) and item_ids."""
    out = docs.drop(*ADDED)
    out = out.withColumns({name: F.lit(None).cast(kind) for name, kind in _SCAN_TYPES.items()})
    at, held = out.columns.index(text_col), None
    for block in item_blocks(benchmark, item_col, item_text_col, block_bytes):
        if held is not None:  # what one block finds is written before another is held
            out = stage(out, "hits")
            held.destroy()
        held = docs.sparkSession.sparkContext.broadcast(WindowSet([(r.i, r.t) for r in block.collect()], n))
        out = mark_block(out, at, held)
    return out


def remove_spans(marked: DataFrame, text_col: str = "text") -> DataFrame:
    """Cut the hit words, and what lies between them, out of the texts.

    Takes the result of :func:`mark_hits`; each run goes from its first word's first byte
    to its last word's last byte, the rest of the text stays as it is.
    """
    schema, at, runs_at = marked.schema, marked.columns.index(text_col), marked.columns.index("hit_runs")

    def cut(batches):
        for batch in batches:
            texts = []
            runs = batch.column(runs_at).to_pylist()
            for block in blocks(batch.column(at)):
                w = words(block, ALNUM)
                for d in range(block.n_docs):
                    raw, out, last = block.text(d), b"", 0
                    first, base = int(w.doc_first[d]), int(block.offsets[d])
                    for lo, hi in _pairs(runs[block.first + d] or []):
                        out += raw[last : int(w.start[first + lo]) - base]
                        last = int(w.end[first + hi - 1]) - base
                    texts.append((out + raw[last:]).decode())
            kept = pa.array(texts, batch.column(at).type)
            if batch.column(at).null_count:
                kept = pc.if_else(batch.column(at).is_valid(), kept, None)
            columns = [kept if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return marked.mapInArrow(cut, schema)


def n_hit(runs) -> F.Column:
    """Words inside the union of the hit runs."""
    bounds = F.transform(runs, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return F.aggregate(bounds, F.lit(0).cast("long"), lambda a, x: a + x)


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = 10) -> DataFrame:
    """Remove contaminated documents, or (``mode="spans"``) only the contaminated words."""
    marked = mark_hits(docs, benchmark, n)
    if mode == "documents":
        return marked.where(F.size("hit_runs") == 0).select(*docs.columns)
    if mode == "spans":
        return remove_spans(marked).select(*docs.columns)
    raise ValueError(f"mode must be 'documents' or 'spans', not {mode!r}")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark_hits(docs, read(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return marked.select(
        "doc_id",
        "n_words",
        n_hit(F.col("hit_runs")).alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_runs") > 0).alias("contaminated"),
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark window go.

    Rows are judged one by one: null or repeated ids change nothing, null and empty texts stay;
    an empty table, or benchmark, rejects nothing.
    """
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
bw as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as p from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (
  select doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n)),
hit as (select doc_id, p, dw.n, item_id from dw join bw using (n, g)),
words as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from hit) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as listed
  from (select distinct doc_id, item_id::varchar as i from hit) group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""

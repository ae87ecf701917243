"""Operator 10: removal of byte strings of ``LENGTH`` that start anywhere else, by suffixes.

A full suffix array of the corpus would hold a row for each byte. This one is sparse and
still exact:

1. *Anchors.* Of every 200-byte window, the anchor is the leftmost of the smallest 16-byte
   gram hashes among its first 137 starts. It depends on the window alone, so equal windows
   have equal anchors; neighbouring windows share theirs, about one anchor in 69 bytes. A
   record is the suffix at an anchor: its leading 8 bytes, hashes of its 64-byte core (inside
   all its windows) and, 128 bits, of its whole context.
2. *Order.* Records are range-partitioned by leading bytes, core and context, equal ones by
   place, at splitters sampled from them, and sorted in their bucket. Neighbours are compared:
   a core that stands alone is done; where a whole context recurs all its windows recur; cores
   in several contexts are the edges of repeats and go on, one record for each context. The
   first and last core of a bucket may go on in the next: their contexts are counted across
   buckets (two cores a bucket at most), and where there is more than one record of them the
   core goes on too. No core is ever one task's.
3. *Suffixes.* Contexts at edges of repeats (one for each distinct context) are range-partitioned
   by their core. A bucket sorts the suffixes at its window starts by multikey quicksort over
   8-byte characters: each level orders what still ties and drops what stands alone; what ties
   through all 200 bytes recurs. Equal cores are equal range keys, so no comparison is lost at
   a boundary between buckets; the last group of a batch is carried over to the next. The rest,
   cores with more than ``hot`` contexts, would be one bucket each: their windows are compared
   by 128-bit digests instead, pre-aggregated before the shuffle.
4. *Removal.* Covered runs are gathered by document and cut out of the bytes.

Where 128-bit hashes decide, unequal strings pass as equal with probability 2^-128 a pair.

Strings are judged on the input; matches never cross documents; rows that repeat id and text
are copies like any others, and are told apart from rows of the same id, or without one, by 128
bits of their text's SHA-256. Null and empty texts have 0 bytes; null ids are kept as null.
Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stage, text_of
from .textkernel import Block, _power_tables, blocks, mix64

LENGTH, CORE, GRAM = 200, 64, 16
SPREAD = LENGTH - CORE + 1
HOT = 20_000
#: Records of one core that a task holds before it passes them on as it does at a bucket's edge.
HELD = 200_000
#: A number for each byte value, for the second of two hashes.
_DIGITS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values: block-wise prefix and suffix minima."""
    n = len(key)
    wide = -(-n // width) * width
    padded = np.full(wide, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def substring_hashes(digits: np.ndarray):
    """A function of (starts, ends) that hashes substrings, and its prefix sums."""
    n = len(digits)
    up, down = _power_tables(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(digits * up[:n], out=prefix[1:])
    return lambda s, e: mix64((prefix[e] - prefix[s]) * down[s] + (e - s).astype(np.uint64)), prefix


def records(block: Block) -> tuple[np.ndarray, ...]:
    """(document, anchor, first and last window start, leading bytes, core hash, two context
    hashes) in block bytes."""
    n = len(block.data)
    none = tuple(np.empty(0, t) for t in (*[np.int64] * 4, *[np.uint64] * 4))
    if n < LENGTH:
        return none
    _, down = _power_tables(n + 1)
    hashed, prefix = substring_hashes(block.data.astype(np.uint64) + np.uint64(1))
    gram = mix64((prefix[GRAM:] - prefix[:-GRAM]) * down[: n - GRAM + 1])
    key = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    least = sliding_least(key, SPREAD)
    length = np.diff(block.offsets)
    valid = np.zeros(n + 1, np.int32)
    fits = length >= LENGTH
    np.add.at(valid, block.offsets[:-1][fits], 1)
    np.add.at(valid, block.offsets[1:][fits] - LENGTH + 1, -1)
    window = np.flatnonzero(np.cumsum(valid)[: len(least)])
    if not len(window):
        return none
    anchor = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.searchsorted(block.offsets, window, "right") - 1
    fresh = np.ones(len(window), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(fresh)
    lo, hi = window[at], window[np.append(at[1:], len(window)) - 1]
    a = anchor[at]
    second, _ = substring_hashes(_DIGITS[block.data])
    place = (a - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    lead = np.ndarray((n - 7,), ">u8", np.ascontiguousarray(block.data), strides=(1,))[a].astype(np.uint64)
    return doc[at], a, lo, hi, lead, hashed(a, a + CORE), *(mix64(h(lo, hi + LENGTH) + place) for h in (hashed, second))


_RECORDS = "doc_id long, th binary, lead long, core long, ctx long, ctx2 long, a long, l int, r int"


def record_table(docs: DataFrame) -> DataFrame:
    """Records of the documents given as (doc_id, th, text); l and r reach back from the anchor."""

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(2)):
                doc, a, lo, hi, lead, *keys = records(block)
                rows = pa.array(doc + block.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows), batch.column(1).take(rows),
                        # Leading bytes in their own order: the sign bit is turned.
                        pa.array((lead ^ np.uint64(1 << 63)).view(np.int64)), *[pa.array(k.view(np.int64)) for k in keys], pa.array(a - block.offsets[doc]),
                        pa.array((a - lo).astype(np.int32)), pa.array((a - hi).astype(np.int32)),
                    ],
                    names=["doc_id", "th", "lead", "core", "ctx", "ctx2", "a", "l", "r"],
                )

    return docs.mapInArrow(run, _RECORDS)


_COMPARED = "doc_id long, th binary, core long, a long, l int, r int, kinds long, many boolean, first boolean, edge boolean"


def _fresh(table: pa.Table, *names: str) -> np.ndarray:
    """Where a row differs from the one before in one of the columns."""
    out = np.ones(table.num_rows, bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in (table.column(n).to_numpy() for n in names)], axis=0)
    return out


def compare_neighbours(ordered: DataFrame, most_held: int = HELD) -> DataFrame:
    """Of records in order, those whose core recurs: whether there are ``many`` of the context,
    whether a record is its ``first``, and ``kinds``, the contexts of the core.

    The first and last core of a bucket are its ``edge``: all their records are passed on, without
    kinds, and compared only within the bucket. A context that goes on in the next bucket has a
    first record in each, which stand for two contexts from there on and meet as equals later.
    """

    def rows(table: pa.Table, keep: np.ndarray, kinds: np.ndarray, many: np.ndarray, first: np.ndarray, edge: bool) -> list[pa.RecordBatch]:
        found = table.select(["doc_id", "th", "core", "a", "l", "r"]).take(pa.array(keep))
        for name, column in (("kinds", kinds[keep]), ("many", many[keep]), ("first", first[keep]), ("edge", np.full(len(keep), edge))):
            found = found.append_column(name, pa.array(column))
        return found.to_batches()

    def whole(table: pa.Table) -> list[pa.RecordBatch]:
        """Records of cores that begin and end here."""
        fresh, first = _fresh(table, "core"), _fresh(table, "core", "ctx", "ctx2")
        core, context = np.cumsum(fresh) - 1, np.cumsum(first) - 1
        keep = np.flatnonzero(np.bincount(core)[core] > 1)
        return rows(table, keep, np.bincount(core[first])[core], np.bincount(context)[context] > 1, first, False)

    def piece(table: pa.Table, before: tuple | None) -> list[pa.RecordBatch]:
        """Records of an edge's core; ``before`` is the context that was passed on last."""
        first = _fresh(table, "ctx", "ctx2")
        context = np.cumsum(first) - 1
        many = np.bincount(context)[context] > 1
        if before == (table.column("ctx")[0].as_py(), table.column("ctx2")[0].as_py()):
            many[context == 0], first[0] = True, False
        return rows(table, np.arange(len(first)), np.zeros(len(first), np.int64), many, first, True)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        open_core, before, began = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            held, core = None, table.column("core").to_numpy()
            if not began:
                began, open_core = True, core[0]
            if open_core is not None:
                other = core != open_core
                over = bool(other.any())
                k = int(other.argmax()) if over else len(core)
                if not over:
                    # The last context may go on; a record alone waits for its like.
                    last = _fresh(table, "ctx", "ctx2")
                    key = (table.column("ctx")[-1].as_py(), table.column("ctx2")[-1].as_py())
                    if last[-1] and key != before:
                        held, k = table.slice(k - 1), k - 1
                if k:
                    part = table.slice(0, k).combine_chunks()
                    yield from piece(part, before)
                    before = (part.column("ctx")[-1].as_py(), part.column("ctx2")[-1].as_py())
                if not over:
                    continue
                table, core, open_core, before = table.slice(k).combine_chunks(), core[k:], None, None
            change = np.flatnonzero(core[1:] != core[:-1])
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                yield from whole(table.slice(0, cut).combine_chunks())
            held = table.slice(cut)
            if held.num_rows > most_held:
                open_core = core[-1]
        if held is not None and held.num_rows:
            yield from piece(held.combine_chunks(), before)

    return ordered.mapInArrow(run, _COMPARED)


def edge_cores(compared: DataFrame) -> dict[int, int]:
    """Contexts of the cores that stand at edges of buckets in more than one; two cores a bucket
    and a few that are very frequent."""
    counts = compared.where("edge and first").groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    return {r.core: r.kinds for r in counts.collect()}


def contexts(docs: DataFrame) -> DataFrame:
    """Context bytes of the records listed with each document (doc_id, th, text, wanted)."""

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(2)):
                out = {k: [] for k in ("doc_id", "th", "core", "many", "hot", "a", "l", "r", "lead", "bytes")}
                ids = batch.column(0).slice(block.first, block.n_docs).to_pylist()
                ths = batch.column(1).slice(block.first, block.n_docs).to_pylist()
                for i, wanted in enumerate(batch.column(3).slice(block.first, block.n_docs).to_pylist()):
                    raw = block.text(i)
                    for w in wanted:
                        a, left, right = w["a"], w["l"], w["r"]
                        out["doc_id"].append(ids[i])
                        out["th"].append(ths[i])
                        for k in ("core", "many", "hot", "a", "l", "r"):
                            out[k].append(w[k])
                        out["lead"].append(raw[a : a + CORE])
                        out["bytes"].append(raw[a - left : a - right + LENGTH])
                yield pa.RecordBatch.from_pydict(out, schema=_CONTEXT_ARROW)

    return docs.mapInArrow(run, _CONTEXTS)


_CONTEXTS = "doc_id long, th binary, core long, many boolean, hot boolean, a long, l int, r int, lead binary, bytes binary"
_CONTEXT_ARROW = pa.schema([("doc_id", pa.int64()), ("th", pa.binary()), ("core", pa.int64()), ("many", pa.bool_()), ("hot", pa.bool_()), ("a", pa.int64()), ("l", pa.int32()), ("r", pa.int32()), ("lead", pa.binary()), ("bytes", pa.binary())])
_RUNS = "doc_id long, th binary, s long, e long"


def multikey_ties(text: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix, cut to ``length``, equals another of its group.

    Multikey quicksort, all partitions of a level at once: 8-byte big-endian characters, one
    level at a time, ordered only within ties of the levels before; suffixes alone leave.
    """
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    character = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    live, tie = np.arange(len(start)), group
    for depth in range(0, length, 8):
        c = character[start[live] + min(depth, length - 8)].astype(np.uint64)
        order = np.lexsort((c, tie))
        live, c, tie = live[order], c[order], tie[order]
        new = np.ones(len(live), bool)
        new[1:] = (tie[1:] != tie[:-1]) | (c[1:] != c[:-1])
        tie = np.cumsum(new)
        crowd = np.bincount(tie)[tie] > 1
        live, tie = live[crowd], tie[crowd]
        if not len(live):
            break
    out = np.zeros(len(start), bool)
    out[live] = True
    return out


def _window_starts(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(record, start in the joined contexts) of every window of the records."""
    count = left - right + 1
    record = np.repeat(np.arange(len(count)), count)
    inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return record, (np.cumsum(size) - size)[record] + inner


def _runs(table: pa.Table, record: np.ndarray, inner: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
    """Merged covered runs of the records that are not settled already."""
    many = table.column("many").to_numpy(zero_copy_only=False)
    keep = np.flatnonzero(hit & ~many[record])
    record, inner = record[keep], inner[keep]
    fresh = np.ones(len(record), bool)
    fresh[1:] = (record[1:] != record[:-1]) | (inner[1:] != inner[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(record))[: len(first)] - 1
    rows = record[first]
    base = table.column("a").to_numpy()[rows] - table.column("l").to_numpy()[rows]
    pick = pa.array(rows)
    columns = [table.column(n).take(pick).combine_chunks() for n in ("doc_id", "th")]
    return pa.RecordBatch.from_arrays([*columns, pa.array(base + inner[first]), pa.array(base + inner[last] + LENGTH)], names=["doc_id", "th", "s", "e"])


def sort_buckets(ordered: DataFrame) -> DataFrame:
    """Covered runs, from contexts range-partitioned and sorted by their leading bytes."""

    def flush(table: pa.Table) -> pa.RecordBatch:
        pieces = table.column("bytes").to_pylist()
        text = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.array([len(x) for x in pieces], np.int64)
        left, right = table.column("l").to_numpy().astype(np.int64), table.column("r").to_numpy().astype(np.int64)
        group = np.unique(np.array(table.column("lead").to_pylist(), f"S{CORE}"), return_inverse=True)[1] if len(pieces) else np.empty(0, np.int64)
        record, start = _window_starts(left, right, size)
        hit = multikey_ties(text, start, group[record], LENGTH)
        return _runs(table, record, start - (np.cumsum(size) - size)[record], hit)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                held.append(part)
                rows += part.num_rows
                if rows < 2048:
                    continue
                table = pa.Table.from_batches(held)
                leads = table.column("lead")
                cut, last = table.num_rows, leads[-1]
                while cut and leads[cut - 1] == last:  # the last group may go on
                    cut -= 1
                if cut:
                    yield flush(table.slice(0, cut).combine_chunks())
                held = table.slice(cut).to_batches()
                rows = table.num_rows - cut
        if held:
            yield flush(pa.Table.from_batches(held).combine_chunks())

    return ordered.mapInArrow(run, _RUNS)


def digest_windows(table: DataFrame) -> DataFrame:
    """Covered runs of hot cores: window digests, counted before the shuffle."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                pieces = part.column("bytes").to_pylist()
                data = np.frombuffer(b"".join(pieces), np.uint8)
                size = np.array([len(x) for x in pieces], np.int64)
                left, right = (part.column(c).to_numpy().astype(np.int64) for c in ("l", "r"))
                record, start = _window_starts(left, right, size)
                digests = [substring_hashes(d)[0](start, start + LENGTH) for d in (data.astype(np.uint64) + np.uint64(1), _DIGITS[data])]
                at = part.column("a").to_numpy()[record] - left[record] + start - (np.cumsum(size) - size)[record]
                pick = pa.array(record)
                columns = [part.column(c).take(pick) for c in ("doc_id", "th", "many")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(at), *[pa.array(d.view(np.int64)) for d in digests]], names=["doc_id", "th", "many", "s", "d1", "d2"])

    each = stage(table.mapInArrow(run, "doc_id long, th binary, many boolean, s long, d1 long, d2 long"), "suffix-digests")
    twice = stage(each.groupBy("d1", "d2").count().where("count > 1").select("d1", "d2"), "suffix-twice")
    return each.where("not many").join(twice, ["d1", "d2"], "left_semi").select("doc_id", "th", "s", (F.col("s") + LENGTH).alias("e"))


def covered_runs(source: DataFrame, hot: int = HOT, most_held: int = HELD) -> DataFrame:
    """Runs (doc_id, th, s, e) whose union is what recurs; ``source`` has (doc_id, th, text)."""
    keys = ["lead", "core", "ctx", "ctx2"]
    table = record_table(source).repartitionByRange(*keys, F.xxhash64("doc_id", "th", "a")).sortWithinPartitions(*keys, "doc_id", "th", "a")
    table = stage(compare_neighbours(table, most_held), "suffix-candidates")
    settled = table.where("many").select("doc_id", "th", (F.col("a") - F.col("l")).alias("s"), (F.col("a") - F.col("r") + LENGTH).alias("e"))

    edges = edge_cores(table)
    crowded = F.col("core").isin(sorted(c for c, n in edges.items() if n > hot))
    wanted = table.where("first").where((F.col("kinds") > 1) | (F.col("edge") & F.col("core").isin(sorted(edges))))
    listed = F.struct("core", "many", ((F.col("kinds") > hot) | (F.col("edge") & crowded)).alias("hot"), "a", "l", "r")
    wanted = wanted.groupBy("doc_id", "th").agg(F.collect_set(listed).alias("wanted"))
    wanted = wanted.select(F.col("doc_id").alias("w_id"), F.col("th").alias("w_th"), "wanted")
    # Rows that repeat id and text have equal contexts; one of them stands for all.
    met = source.join(wanted, source["doc_id"].eqNullSafe(wanted["w_id"]) & (source["th"] == wanted["w_th"]))
    found = stage(contexts(met.select("doc_id", "th", "text", "wanted")).dropDuplicates(["doc_id", "th", "a"]), "suffix-contexts")
    ordered = found.where("not hot").repartitionByRange("lead").sortWithinPartitions("lead")
    out = settled.unionByName(sort_buckets(ordered))
    hots = found.where("hot")
    return out.unionByName(digest_windows(hots)) if hots.limit(1).count() else out


def remove_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of (doc_id, text, runs as flat bounds)."""

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(1)):
                kept, removed, spans = [], [], []
                for i, flat in enumerate(batch.column(2).slice(block.first, block.n_docs).to_pylist()):
                    raw = block.text(i)
                    if not flat:
                        kept.append(raw)
                        removed.append(0)
                        spans.append(0)
                        continue
                    bounds = sorted(zip(flat[::2], flat[1::2], strict=True))
                    parts, at, n = [], 0, 0
                    for s, e in bounds:
                        if not n or s > at:
                            parts.append(raw[at:s])
                            n += 1
                        at = max(at, e)
                    parts.append(raw[at:])
                    kept.append(b"".join(parts))
                    removed.append(len(raw) - len(kept[-1]))
                    spans.append(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n_docs), pa.array(np.diff(block.offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def row_digest(text: F.Column) -> F.Column:
    """16 bytes of the text's SHA-256: with the id, what tells rows apart."""
    return F.unhex(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 32))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, most_held: int = HELD) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (bytes)."""
    text = text_of(docs, text_col)
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), row_digest(text).alias("th"), text.alias("text"))
    runs = covered_runs(source, hot, most_held).groupBy("doc_id", "th").agg(F.flatten(F.collect_set(F.array("s", "e"))).alias("runs"))
    runs = stage(runs.select(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th"), "runs"), "suffix-runs")
    joined = source.join(runs, source["doc_id"].eqNullSafe(runs["r_id"]) & (source["th"] == runs["r_th"]), "left")
    return remove_runs(joined.select("doc_id", "text", "runs"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

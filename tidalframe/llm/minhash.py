"""Operator 7: near-dedup with Circulant MinHash, banding and exact verification.

*Sets.* A-Z lower-cased, words are runs of non-space bytes, a document's set holds its
distinct 5-word shingles (64-bit hashes); a shorter text is one shingle, an empty one none.

*Signature.* Two bijections of the 32-bit ring stand for the two permutations: ``sigma``
breaks the structure of the shingles once, ``pi`` gives every coordinate k as
``min(pi((sigma(x) + k) mod 2^32))``, that is one permutation circularly shifted. 128
coordinates in 32 bands of 4: a pair at similarity 0.75 shares no band with probability
5e-6, at 0.8 with 5e-8.

*Links without all pairs.* Documents with equal sets are one node. The first round tests every
node of a band bucket against the bucket's least node only, which joins a large group at once.
Buckets whose nodes are then still in different components go on: shingles that no other such
node has, and losses against the bucket's most central node, bound the similarity of two nodes,
which rules out most pairs exactly. Nodes are ordered by what they share, and the first become
hubs in turn (1, 15, 240 ... of a bucket), tested against later nodes of other components.
After the last round any two nodes of a bucket have been tested, ruled out or connected, so no
cap is needed and components equal those of testing all pairs. Each candidate is confirmed on
the full sets of 64-bit shingle hashes, made of word hashes without linear structure (two unequal
shingles of texts that were not made to collide pass as equal with probability 2^-64).

*Hot buckets.* A bucket is never one task's: counts, least nodes and labels of buckets, labels and
common shingles are aggregated before the shuffle and, staged, joined back, which the adaptive
planner splits where a key is frequent; hubs are a top-k of each bucket, taken map-side first.

*Components.* Smallest-label propagation with pointer jumping over the confirmed links,
each step a staged table; nothing is collected.

Defined results: null ids are kept apart from components of others only in the output's
``doc_id``; a component without any id has a null component_id. Repeated rows fall
into one node. Documents without words have n_shingles 0 and are their own component.
Only the two named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stage, text_of, without_rows
from .textkernel import NON_SPACE, blocks, gram_hashes, inside_document, lane_hashes, mix64, whole_hash, words

SHINGLE = 5
BANDS, ROWS = 32, 4
#: Least similarity as a fraction of whole numbers: 75 / 100.
SIM_NUM, SIM_DEN = 75, 100
#: Groups of shingles in which a node's losses against its bucket's pivot are counted.
GROUPS = 64
#: Bits of the filter for ids whose sets are needed (8 MiB).
FILTER_BITS = 1 << 26
_SKETCH = "doc_id long, text_hash long, n_shingles long, node binary, bands array<long>"


def _mix32(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of the 32-bit ring."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def sigma(shingles: np.ndarray) -> np.ndarray:
    return _mix32((shingles >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)


def pi(x: np.ndarray) -> np.ndarray:
    return _mix32(x, 0x21F0AAAD, 0x735A2D97)


def shingle_sets(column: pa.Array, n: int = SHINGLE):
    """Per block: (block, distinct sorted shingle hashes, bounds of each document)."""
    for block in blocks(column):
        w = words(block, NON_SPACE, lane_hashes)
        counts = np.diff(w.doc_first)
        at = inside_document(w.doc_first, n)
        grams = gram_hashes(w.hash, n)[at]
        doc = np.searchsorted(w.doc_first, at, "right") - 1
        few = np.flatnonzero((counts > 0) & (counts < n))
        if len(few):
            grams = np.concatenate([grams, np.array([whole_hash(w.hash[w.doc_first[d] : w.doc_first[d + 1]]) for d in few], np.uint64)])
            doc = np.concatenate([doc, few])
        order = np.lexsort((grams, doc))
        grams, doc = grams[order], doc[order]
        fresh = np.ones(len(grams), bool)
        if len(grams) > 1:
            fresh[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
        grams, doc = grams[fresh], doc[fresh]
        yield block, grams, np.searchsorted(doc, np.arange(block.n_docs + 1))


def signatures(grams: np.ndarray, first: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of each non-empty set: a row of ``coordinates`` minima."""
    x = sigma(grams)
    out = np.empty((len(first), coordinates), np.uint32)
    chunk = 1 << 14
    # Sets longer than a chunk are reduced chunk by chunk so that the passes stay in cache.
    out[:] = np.uint32(0xFFFFFFFF)
    ends = np.append(first[1:], len(x))
    lo = 0
    while lo < len(x):
        hi = min(lo + chunk, len(x))
        a = int(np.searchsorted(ends, lo, "right"))
        b = int(np.searchsorted(first, hi, "left"))
        cuts = np.maximum(first[a:b], lo) - lo
        piece = x[lo:hi]
        for k in range(coordinates):
            got = np.minimum.reduceat(pi(piece + np.uint32(k)), cuts)
            np.minimum(out[a:b, k], got, out=out[a:b, k])
        lo = hi
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band, with the band's number mixed in."""
    parts = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)).copy()
    for j in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.astype(np.int64)


def node_keys(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128-bit hash of each set, independent of order; zero for an empty set."""
    nodes = np.zeros((len(bounds) - 1, 2), np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        first = bounds[:-1][some]
        nodes[some, 0] = np.add.reduceat(mix64(grams), first)
        nodes[some, 1] = np.add.reduceat(mix64(grams * np.uint64(0xD6E8FEB86659FD93)), first)
    return nodes


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """n_shingles, node (128-bit hash of the set) and band keys of each (doc_id, text, text_hash)."""

    def run(batches):
        for batch in batches:
            for block, grams, bounds in shingle_sets(batch.column(1)):
                sizes = np.diff(bounds)
                some = np.flatnonzero(sizes)
                nodes, keys = node_keys(grams, bounds), np.empty((0, bands), np.int64)
                if len(some):
                    keys = band_keys(signatures(grams, bounds[:-1][some], bands * rows), bands, rows)
                offs = np.zeros(block.n_docs + 1, np.int32)
                offs[1:] = np.cumsum((sizes > 0) * bands)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.n_docs),
                        batch.column(2).slice(block.first, block.n_docs),
                        pa.array(sizes, pa.int64()),
                        pa.array([x.tobytes() for x in nodes], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(keys.ravel(), pa.int64())),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "node", "bands"],
                )

    return docs.mapInArrow(run, _SKETCH)


def id_filter(ids: DataFrame, id_col: str, bits: int = FILTER_BITS) -> list[tuple[int, bytes]]:
    """A bit for each id's hash, as (bucket, 4 KiB bitmap) rows: ``bits / 8`` bytes at most.

    A false positive only costs work, so the size needs no growth with the ids.
    """
    place = F.pmod(F.xxhash64(id_col), F.lit(bits)) + 1  # bitmap functions count from 1
    maps = ids.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    return [(r.bucket, bytes(r.map)) for r in maps.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map")).collect()]


def full_sets(texts: DataFrame, keep: list[tuple[int, bytes]], bits: int = FILTER_BITS) -> DataFrame:
    """(node, shingles) of the (doc_id, text) rows that the id filter lets through."""
    flat = np.zeros(bits // 8, np.uint8)
    for bucket, bitmap in keep:
        flat[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bitmap, np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(flat)

    def run(batches):
        for batch in batches:
            place = batch.column(0).to_numpy()
            held = shared.value[place >> 3] >> (place & 7).astype(np.uint8) & 1
            for block, grams, bounds in shingle_sets(batch.column(1).filter(pa.array(held.astype(bool)))):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x.tobytes() for x in node_keys(grams, bounds)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(grams.astype(np.int64), pa.int64())),
                    ],
                    names=["node", "shingles"],
                )

    placed = texts.select(F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("place"), "text")
    return placed.mapInArrow(run, "node binary, shingles array<long>")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return both.where(SIM_DEN * common >= SIM_NUM * union).select("a", "b")


#: Before: larger share of shingles, then smaller node.
_LATER = "(shared < sa or shared = sa and node > a) and label <> la"


def hub_pairs(hubs: DataFrame, members: DataFrame, where: str = "true") -> DataFrame:
    """Distinct pairs (a, b) of a hub and a member of its bucket that may be similar enough.

    No pair is built whose sizes, or shared shingles where known, rule it out.
    """
    known = "shared" in members.columns
    cols = {"a": "node", "na": "n"} | ({"la": "label", "sa": "shared", "ma": "missing"} if known else {})
    hub = hubs.select("key", *[F.col(v).alias(k) for k, v in cols.items()])
    both = hub.join(members, "key").where(where).where(f"{SIM_DEN} * least(n, na) >= {SIM_NUM} * greatest(n, na)")
    if known:
        both = both.where(f"({SIM_DEN} + {SIM_NUM}) * least(shared, sa) >= {SIM_NUM} * (n + na)")
        # Of the pivot's shingles both can share only what neither lacks; besides, only what
        # each shares with others outside the pivot.
        lacking = F.aggregate(F.zip_with("missing", "ma", lambda x, y: F.greatest(x, y)), F.lit(0), lambda acc, x: acc + x)
        held = lambda m: F.col("pivot_n") - F.aggregate(m, F.lit(0), lambda acc, x: acc + x)
        beside = F.least(F.col("shared") - held("missing"), F.col("sa") - held("ma"))
        most = F.col("pivot_n") - lacking + F.greatest(beside, F.lit(0))  # the pivot itself may go below 0
        both = both.where((SIM_DEN + SIM_NUM) * most >= SIM_NUM * (F.col("n") + F.col("na")))
    return both.select("a", F.col("node").alias("b")).distinct()


def mixed_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with labels, of buckets whose nodes lie in different components (staged)."""
    pool = stage(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    mixed = stage(pool.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("key"), "mixed-keys")
    return stage(pool.join(mixed, "key", "left_semi"), "mixed")


def against_pivots(pool: DataFrame, sets: DataFrame) -> DataFrame:
    """``pool`` with, against the most central node of its bucket (it shares most shingles),
    pivot_n and ``missing``: how many of the pivot's shingles a node lacks, in each of
    ``GROUPS`` groups of shingles."""
    central = F.min(F.struct((-F.col("shared")).alias("s"), "node", "n")).alias("c")
    pivots = stage(pool.groupBy("key").agg(central).select("key", F.col("c.node").alias("pivot"), F.col("c.n").alias("pivot_n")), "pivots")
    placed = stage(pool.join(pivots, "key"), "placed")
    pairs = placed.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    lost = pairs.join(left, "a").join(right, "b").select("a", "b", F.array_except("sa", "sb").alias("lost"))
    groups = F.sequence(F.lit(0), F.lit(GROUPS - 1))
    missing = F.transform(groups, lambda g: F.size(F.filter("lost", lambda s: F.pmod(s, F.lit(GROUPS)) == g)))
    lost = lost.select(F.col("a").alias("pivot"), F.col("b").alias("node"), missing.alias("missing"))
    return placed.join(lost, ["pivot", "node"]).drop("pivot")


def shared_shingles(sets: DataFrame) -> DataFrame:
    """(node, shared): how many of a node's shingles some other node has as well."""
    each = sets.select("node", F.explode("shingles").alias("s"))
    alone = each.groupBy("s").agg(F.count(F.lit(1)).alias("copies"), F.min("node").alias("node")).where("copies = 1")
    alone = alone.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    return sets.join(alone, "node", "left").select("node", (F.size("shingles") - F.coalesce("alone", F.lit(0))).alias("shared"))


def first_of_buckets(pool: DataFrame, lo: int, hi: int) -> DataFrame:
    """The nodes of rank ``lo`` to ``hi`` in their bucket; a top-k, limited before the shuffle."""
    order = Window.partitionBy("key").orderBy(F.desc("shared"), "node")
    return pool.withColumn("rank", F.row_number().over(order)).where(f"rank <= {hi}").where(f"rank > {lo}").drop("rank")


def components(links: DataFrame, nodes: DataFrame | None = None, name: str = "component") -> DataFrame:
    """(node, label) with label the smallest node reachable over the links (a, b).

    ``nodes`` may carry labels from an earlier call over fewer links to start from.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = stage(both.union(both.select("v", "u")).distinct(), f"{name}-edges")
    labels = both.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node"))
    if nodes is not None:
        labels = labels.drop("label").join(nodes, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    labels = stage(labels, f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("u", "node"), "node", "left")
        step = step.select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("further"))
        step = step.join(jump, "new", "left").select("node", F.least("new", F.coalesce("further", "new")).alias("label"), (F.col("new") < F.col("label")).alias("moved"))
        step = stage(step, f"{name}-labels")
        if not step.where("moved").limit(1).count():
            return step.select("node", "label")
        labels = step.select("node", "label")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n_shingles, node) of every row, and (node, label, first_id) of the
    nodes: non-empty sets of shingles, with the label of their component."""
    text = text_of(docs, text_col)
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    sketched = stage(sketch(source, bands, rows), "sketch")
    filled = sketched.where("n_shingles > 0")
    nodes = filled.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = stage(nodes, "nodes")
    keyed = nodes.select("node", "n", "first_id", F.explode("bands").alias("key"))
    several = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub")).where("size > 1").select("key", "hub")
    ranked = stage(keyed.join(stage(several, "bucket-keys"), "key").select("key", "hub", "node", "n", "first_id"), "buckets")

    # A node's text is read from a row of its smallest id, found map-side by a filter of fixed
    # size: texts are not shuffled. What the filter lets through besides, the node sorts out.
    wanted = ranked.select("node", "first_id").distinct()
    sets = full_sets(source.select("doc_id", "text"), id_filter(wanted, "first_id")).join(wanted.select("node"), "node", "left_semi")
    sets = stage(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")

    hubs = stage(ranked.where("node = hub").select("key", "node", "n"), "hubs")
    links = stage(confirm(hub_pairs(hubs, ranked.where("node <> hub").select("key", "node", "n")), sets), "links")
    labels = components(links)

    pool, members = mixed_buckets(ranked.select("key", "node", "n"), labels), sets
    if pool.limit(1).count():
        # Shingles that no other node of a mixed bucket has bound every similarity from above.
        members = stage(sets.join(pool.select("node").distinct(), "node", "left_semi"), "mixed-sets")
        able = pool.drop("label").join(shared_shingles(members), "node").where(f"{SIM_DEN} * shared >= {SIM_NUM} * n")
        pool = mixed_buckets(against_pivots(stage(able, "central"), members), labels)
    lo, hi = 0, 1
    while pool.limit(1).count():
        hubs = stage(first_of_buckets(pool, lo, hi), "hubs")
        if not hubs.limit(1).count():
            break
        pairs = stage(hub_pairs(hubs, pool, _LATER), "pairs")
        ends = stage(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "ends")
        found = stage(confirm(pairs, members.join(ends, "node", "left_semi")), "links")
        if found.limit(1).count():
            links = links.unionByName(found)
            labels = components(links, labels)
        pool = mixed_buckets(pool.drop("label"), labels)
        lo, hi = hi, 16 * hi

    of_node = nodes.select("node", "first_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return sketched.select("doc_id", "text_hash", "n_shingles", "node"), stage(of_node, "node-labels")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    sketched, of_node = near_groups(docs, id_col, text_col, bands, rows)
    head = stage(of_node.groupBy("label").agg(F.min("first_id").alias("component_id")), "heads")
    assigned = of_node.join(head, "label").select("node", "component_id")
    full = sketched.where("n_shingles > 0").join(assigned, "node").select("doc_id", "n_shingles", "component_id")
    empty = sketched.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = full.unionByName(empty)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"))


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of near duplicates one row stays, that of smallest id.

    Rows are told apart by id and text: of rows of one id the one of least text hash stays, of
    rows that repeat both, one. Rows without an id stay only where a component has no other,
    rows without words always. An empty table gives an empty result.
    """
    sketched, of_node = near_groups(docs)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    rows = stage(sketched.where("n_shingles > 0").join(of_node.select("node", "label"), "node").select("label", "doc_id", "text_hash", row.alias("row")), "near-rows")
    best = stage(rows.groupBy("label").agg(F.min("row").alias("best")), "near-best")
    lost = rows.join(best, "label").where("row <> best").select("doc_id", "text_hash")
    same = rows.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash")
    return without_rows(docs, lost, same)


OP7_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
shingles as (
  select distinct doc_id, array_to_string(w[p : p + 4], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as p from w where len(w) > 0)),
sizes as (select w.doc_id, count(g) as n from w left join shingles using (doc_id) group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b using (g) where a.doc_id <> b.doc_id group by all),
links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * c >= 75 * (x.n + y.n - c)),
reach as (select doc_id, doc_id as r from w union select reach.doc_id, links.b from reach join links on links.a = reach.r)
select doc_id, n as n_shingles, min(r) as component_id, doc_id = min(r) as kept
from reach join sizes using (doc_id) group by doc_id, n
"""

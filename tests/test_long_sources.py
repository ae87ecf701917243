"""Operators over sources of any length against plain loops; one source has most of the rows."""

import bisect
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from tidalframe.operators import buckets, captions, dyadic, intervals, ranking, selection, speculation, streams, tracking, windows
from tidalframe.operators.streams import Ema, NearTime


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    out, k = [], 0
    for source, n in ((1, 900), (2, 40), (3, 1), (4, 59)):
        t = 0.0
        for _ in range(n):
            t += rng.choice([0.0, 0.5, 3.0, 31.0, 200.0]) if rng.random() < 0.3 else rng.random() * 10
            out.append((source, round(t, 3), k, rng.random() * 100, rng.random() < 0.1))
            k += 1
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "source_id long, t double, k long, x double, known boolean")


def by_source(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


ORDER = ("t", "k")


def test_last_and_next_known(rows, table):
    value = F.when(F.col("known"), F.col("x"))
    last = {r.k: r.v for r in windows.filled(table, value, "v", ORDER).collect()}
    ahead = {r.k: r.v for r in buckets.last_known(table, {"v": value}, ORDER, 7.0, back=True, before=True).collect()}
    for source in by_source(rows).values():
        held = None
        for r in source:
            held = r[3] if r[4] else held
            assert last[r[2]] == held
        held = None
        for r in reversed(source):
            assert ahead[r[2]] == held
            held = r[3] if r[4] else held


def test_numbers_changes_and_means(rows, table):
    number = {r.k: r.idx for r in buckets.numbered(table, ORDER).collect()}
    step = {r.k: r.d for r in windows.changes(table, "x", "d", ORDER).collect()}
    for each in (3, 16, 4096):
        mean = {r.k: r.m for r in buckets.neighbourhood(table, F.avg("x"), ORDER, 3, "m", rows_each=each).collect()}
        for source in by_source(rows).values():
            for i, r in enumerate(source):
                near = [y[3] for y in source[max(0, i - 3) : i + 4]]
                assert mean[r[2]] == pytest.approx(sum(near) / len(near))
                assert number[r[2]] == i and step[r[2]] == (r[3] - source[i - 1][3] if i else None)


@pytest.mark.parametrize(("alpha", "width"), [(0.92, 50), (0.0, 7), (1.0, 4096), (0.999999, 1)])
def test_recurrence_equals_the_machine(spark, rows, alpha, width):
    numbered = [(s, i, r[3]) for s, source in by_source(rows).items() for i, r in enumerate(source)]
    df = spark.createDataFrame(numbered, "source_id long, idx long, x double").repartition(5)
    got = {(r.source_id, r.idx): r.y for r in buckets.linear_recurrence(df, alpha, (1 - alpha) * F.col("x"), "idx", "x", "y", width).collect()}
    machines = {}
    for s, i, x in numbered:
        assert got[s, i] == pytest.approx(machines.setdefault(s, Ema(alpha)).step(x), rel=1e-9)
    assert len(got) == len(numbered)


def test_ema_of_one_long_source_uses_all_tasks(spark):
    df = spark.range(200_000).selectExpr("7L as source_id", "id as idx", "cast(id % 97 as double) as x")
    out = tracking.ema_series(df, 0.9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows are few; whole partitions would be merged
    tasks = out.groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 4 and max(r["count"] for r in tasks) < 100_000
    ema = Ema(0.9)
    want = [ema.step(float(i % 97)) for i in range(200_000)]
    assert out.orderBy("idx").toPandas()["ema"].tolist() == pytest.approx(want, rel=1e-9)


def test_interpolation_across_buckets(spark):
    df = spark.range(400).selectExpr("1L as source_id", "id as idx", "if(id in (50, 250), cast(id as double), null) as y")
    got = [r.v for r in windows.interpolated(df, "idx", "y", F.col("y").isNotNull(), "v", width=10).orderBy("idx").collect()]
    assert got == [float(min(max(i, 50), 250)) for i in range(400)]


@pytest.mark.parametrize("gap", [0.5, 30.0])
def test_near_dedup_equals_the_fold(rows, table, gap):
    hits = table.select("source_id", F.col("t").alias("start_s"), F.col("k").alias("hit_id"), F.floor("x").alias("score"), "known")
    got = {r.hit_id: r.known for r in ranking.near_dedup(hits, gap, carry=("known",)).collect()}
    known = {r[2]: r[4] for r in rows}
    want = set()
    for source in by_source(rows).values():
        fold = NearTime(gap)
        out = [fold.step(r[1], r[2], int(r[3])) for r in source] + [fold.last]
        want |= {x[1] for x in out if x is not None}
    assert set(got) == want and all(known[k] == v for k, v in got.items())


def test_quantiles_of_hot_keys(spark):
    rng = random.Random(2)
    data = [("hot", rng.choice([0.0, 1e300, -1e300, 5e-324, rng.random(), rng.gauss(0, 1e6)])) for _ in range(3000)]
    data += [(None, float(i % 3)) for i in range(1501)] + [("same", 4.0)] * 800 + [("few", 1.0), ("few", 2.0), ("none", None)]
    df = spark.createDataFrame(data, "key string, v double")
    for limit in (4, 100, 10_000):
        got = {r.key: (r.quantile, r.n) for r in selection.quantiles(df, "key", "v", limit=limit).collect()}
        for key in ("hot", None, "same", "few"):
            values = [v for k, v in data if k == key]
            assert got[key] == (pytest.approx(median(values)), len(values))
        assert got["none"] == (None, 0)
    got = {r.key: r.quantile for r in selection.quantiles(df, "key", "v", 0.3, limit=50).collect()}
    values = sorted(v for k, v in data if k is None)
    assert got[None] == values[450]
    assert selection.quantiles(df.limit(0), "key", "v").count() == 0


def test_an_interval_has_few_nodes(spark):
    spans = [(0, 10**9), (5, 5), (-5, 9), (1, 6), (0, 7), (3, 4), (-1, 0), (0, 47), (-1, 47), (123_456_789, 10**12 + 5)]
    df = spark.createDataFrame(spans, "lo long, hi long")
    got = df.select("lo", "hi", dyadic.level_of(F.col("lo"), F.col("hi")).alias("level"), dyadic.nodes_of(F.col("lo"), F.col("hi")).alias("nodes"))
    for r in got.collect():
        assert len(r.nodes) <= 2 or r.level == 0 and len(r.nodes) == r.hi - r.lo + 1 <= dyadic.SHORT
        assert r.nodes[0] << r.level <= r.lo and r.hi < (r.nodes[-1] + 1) << r.level


def test_interval_joins_equal_loops(spark):
    rng = random.Random(6)
    points = [(rng.randrange(3), rng.choice([rng.uniform(-50, 200), float(rng.randrange(200))]), i) for i in range(300)]
    spans = [(rng.randrange(4), s := rng.choice([rng.uniform(-50, 200), float(rng.randrange(200))]), s + rng.choice([0.0, 1.0, 5.0, 40.0, 1e9]), i) for i in range(60)]
    p, i = spark.createDataFrame(points, "source_id long, t double, p int"), spark.createDataFrame(spans, "source_id long, start_s double, end_s double, i int")
    for closed in (True, False):
        want = {(a, b) for s, t, a in points for s2, lo, hi, b in spans if s == s2 and lo <= t and (t <= hi if closed else t < hi)}
        got = intervals.interval_join(p, i, closed).select("p", "i").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
        got = intervals.interval_join(p, i, closed, how="left", width=3.0).select("p", "i").collect()
        want |= {(a, None) for _, _, a in points if a not in {x for x, _ in want}}
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    left = i.select("source_id", F.col("start_s").alias("l_start"), F.col("end_s").alias("l_end"), F.col("i").alias("l")).where("l % 2 = 0")
    right = i.where("i % 2 = 1")
    got = intervals.overlap_join(left, right).select("l", "i").collect()
    want = {(x[3], y[3]) for x in spans for y in spans if x[3] % 2 == 0 and y[3] % 2 and x[0] == y[0] and y[1] < x[2] and y[2] > x[1]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert intervals.interval_join(p, i.limit(0), how="left").count() == 300 and intervals.interval_join(p, i.limit(0)).count() == 0


def test_as_of_across_buckets(rows, table):
    ends = table.where("known").select("source_id", F.col("k").alias("seg_idx"), (F.col("t") - 4).alias("start_s"), F.col("t").alias("end_s"))
    got = {r.k: (r.seg_idx, r.active) for r in intervals.next_ending(table.select("source_id", "t", "k"), ends).collect()}
    for source in by_source(rows).values():
        known = [(r[1], r[2]) for r in source if r[4]]
        for r in source:
            at = bisect.bisect_right(known, (r[1], float("inf")))
            assert got[r[2]] == ((known[at][1], known[at][0] - 4 <= r[1]) if at < len(known) else (None, False))


def greedy(rows, width, room, per_line, lines, space):
    """(word, group, line) word by word."""
    out, line, held, used = [], 0, 0, 0.0
    for idx, word in rows:
        if not (word or "").strip():
            continue
        own = sum(width.get(c, 20.0) for c in word.upper())
        if held and (held == per_line or used + (own + space) > room):
            line, held, used = line + 1, 0, 0.0
        used, held = used + own + (space if held else 0.0), held + 1
        out.append((idx, line // lines, line % lines))
    return out


@pytest.mark.parametrize(("per_line", "lines", "block"), [(3, 2, 4), (1, 2, 256), (4, 3, 7)])
def test_packing_across_blocks(spark, per_line, lines, block):
    rng = random.Random(per_line)
    rows = {s: [(i * 3, rng.choice(["a", "Wide", "straße", "", " ", None, "éé", "x" * 30, "iii"])) for i in range(n)] for s, n in ((1, 500), (2, 11), (3, 1))}
    df = spark.createDataFrame([(s, i, w) for s, ws in rows.items() for i, w in ws], "source_id long, word_idx long, word string").repartition(5)
    width = {"I": 7.5, "W": 31.25, "É": 12.0}
    got = {}
    for r in captions.packed_groups(df, width, 120.0, per_line, lines, block=block).collect():
        got.setdefault(r.source_id, []).append((r.word_idx, r.group_idx, r.line_idx))
    for s, ws in rows.items():
        assert sorted(got.get(s, [])) == greedy(ws, width, 120.0, per_line, lines, 10.0)


def test_recovery_is_cut_at_settling_frames(spark):
    rng = random.Random(3)
    face = lambda: {"cx": rng.random() * 1920, "cy": 5.0, "w": rng.choice([60.0, 300.0, 500.0, 600.0, 700.0, 900.0]), "h": rng.choice([80.0, 400.0, 540.0, 700.0]), "score": rng.random()}
    schema = "source_id long, idx long, faces array<struct<cx:double,cy:double,w:double,h:double,score:double>>"
    rows = [(s, i, None if rng.random() < 0.1 else [face() for _ in range(rng.choice([0, 0, 1, 1, 2, 3]))]) for s, n in ((1, 900), (2, 30), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, schema).repartition(5)
    settled = df.where(tracking.settling(F.col("faces"), 1920.0, 1080.0)).count()
    assert 30 < settled < 600
    got = {(r.source_id, r.idx): r.crop_x for r in tracking.track_with_recovery(df, 1920.0, 1080.0, 1.0).collect()}
    machines = {}
    for s, i, faces in rows:
        assert got[s, i] == machines.setdefault(s, streams.Recovery(1920.0, 1080.0, 1.0)).step(faces or [])
    # Whatever the state before, a settling frame leads to the same one.
    for _, _, faces in rows:
        if faces and len(faces) == 1:
            f = faces[0]
            if f["w"] <= 540 and f["h"] <= 540 and 0.5 * (f["w"] * f["h"] / (1920 * 1080) * 0.6 + f["score"] * 0.4) >= 0.15:
                after = set()
                for last, missed, crop in ((None, 0, 656), (10.0, 0, 0), (1900.0, 2, 1313), (5.0, 100, 7)):
                    m = streams.Recovery(1920.0, 1080.0, 1.0).restored((crop, last, missed))
                    m.step(faces)
                    after.add(m.saved())
                assert len(after) == 1


@pytest.mark.parametrize("chunk", [7, 100])
def test_chunks_meet_the_sequential_machines(spark, chunk):
    rng = random.Random(chunk)
    face = lambda: {"cx": rng.choice([0.2, 0.5, 0.8]) + rng.random() / 20, "w": rng.random(), "score": rng.random()}
    schema = "source_id long, idx long, x double, faces array<struct<cx:double,w:double,score:double>>"
    level = {"at": 100.0}

    def value():
        level["at"] = rng.random() * 900 if rng.random() < 0.03 else level["at"]
        return level["at"] + rng.random() * 60

    rows = [(s, i, value(), None if rng.random() < 0.1 else [face() for _ in range(rng.randrange(4))]) for s, n in ((1, 700), (2, 14), (3, 1), (4, 7)) for i in range(n)]
    df = spark.createDataFrame(rows, schema).repartition(6)
    pairs = (lambda **k: tracking.hysteresis(df, needed=3, **k)), (lambda **k: tracking.segment_by_median(df, 100.0, 2.0, src_w=1000, **k))
    for run in pairs:
        got, want = sorted(map(tuple, run(chunk=chunk).collect())), sorted(map(tuple, run().collect()))
        assert got == want and len(want) > 40


def test_chunks_that_never_meet_are_settled_one_a_round(spark):
    """A machine whose state is the sum of all before."""

    class Sum:
        STATE, LIST = "s double", None

        def __init__(self):
            self.s = 0.0

        def saved(self):
            return (self.s,)

        def restored(self, state, listed=()):
            (self.s,) = state
            return self

    def step(m, idx, x):
        m.s += x
        return [(idx, m.s)]

    df = spark.range(40).selectExpr("5L as source_id", "id as idx", "cast(id as double) as x")
    got = speculation.chunked(df, ["x"], lambda idx: Sum(), step, "idx long, s double", 9).collect()
    assert sorted((r.idx, r.s) for r in got) == [(i, i * (i + 1) / 2) for i in range(40)]


def test_frames_of_few_rows_are_dealt(spark):
    from tidalframe.plans.standins import frame_grid

    ends = spark.range(40).selectExpr("id as source_id", "if(id = 7, 3000.0D, id * 1.0D) as end_s").groupBy("source_id").agg(F.max("end_s").alias("end_s"))
    grid = frame_grid(ends, 5)
    want = {(s, i) for s in range(40) for i in range(15000 if s == 7 else 5 * s)}
    got = [(r.source_id, r.frame_idx) for r in grid.collect()]
    assert len(got) == len(want) and set(got) == want
    # The planner sees 40 short rows before the frames: neither these nor the as-of join's rows may be one task's.
    shares = [r.n for r in grid.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(shares) > 4 and max(shares) < len(want) / 2
    groups = ends.select("source_id", F.lit(0).alias("seg_idx"), F.lit(0.0).alias("start_s"), "end_s")
    held = intervals.next_ending(grid.withColumn("t", F.col("frame_idx") / 5), groups)
    assert held.where("seg_idx = 0 and active").count() == len(want)


def test_frames_and_their_groups_are_not_broadcast(spark, sf):
    from tidalframe.plans.queries import QUERIES

    # Frames and words are spelled out after the last size the planner sees, so none of these joins may go by it.
    for name in ("render_cache", "active_word", "speaker_at"):
        out = QUERIES[name](spark, sf)
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        # The one middle a role of speaker_at is as small as it looks.
        assert plan.count("SortMergeJoin") >= 2 and plan.count("BroadcastHashJoin") == (name == "speaker_at"), name

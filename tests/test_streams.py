"""Streaming twins give the batch results, whatever the micro-batches."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidalframe.operators import ranking, streams, tracking
from tidalframe.streaming import online


def stream_of(spark, tmp_path, batches, schema):
    path = str(tmp_path / "in")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def collect(spark, tmp_path, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


SCHEMA = "source_id long, idx long, x double, start_s double, hit_id long, score double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    return [(s, i, rng.random() * 300, i * 13.0, i, rng.random()) for s in (1, 2) for i in range(40)]


@pytest.fixture(autouse=True)
def rocks(spark):
    before = spark.conf.get(online.STORE)
    spark.conf.set(online.STORE, online.ROCKS)
    yield
    spark.conf.set(online.STORE, before)


@pytest.mark.parametrize("cuts", [1, 3, 10])
def test_ema_and_dedup(spark, tmp_path, rows, cuts):
    per = -(-40 // cuts)
    batches = [[r for r in rows if r[1] // per == k] for k in range(cuts)]
    src = stream_of(spark, tmp_path, batches, SCHEMA)
    whole = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.source_id, r.idx, round(r.ema, 9)) for r in collect(spark, tmp_path, online.ema(src), f"ema{cuts}").collect())
    assert got == sorted((r.source_id, r.idx, round(r.ema, 9)) for r in tracking.ema_series(whole).collect())
    kept = {(r.source_id, r.hit_id) for r in collect(spark, tmp_path, online.near_dedup(src), f"dd{cuts}").collect()}
    batch = {(r.source_id, r.hit_id) for r in ranking.near_dedup(whole).collect()}
    assert kept <= batch and len(batch - kept) == 2  # the last of each source is still open
    cut = {(r.source_id, r.start_idx, r.end_idx, r.crop_x) for r in collect(spark, tmp_path, online.segment_by_median(src, 607.0, 2.0), f"seg{cuts}").collect()}
    full = {(r.source_id, r.start_idx, r.end_idx, r.crop_x) for r in tracking.segment_by_median(whole, 607.0, 2.0).collect()}
    assert cut <= full and len(full - cut) == 2


def test_restarts_go_on_from_the_checkpoint(spark, tmp_path, rows):
    """A query that is stopped after each file gives the batch result; rows sent again change nothing."""
    seen = {"ema": set(), "segments": set(), "hysteresis": set()}
    schema = "source_id long, idx long, x double, faces array<struct<cx:double,w:double,score:double>>"
    rows = [(s, i, x, [(x / 300, 0.1, 0.9)] if i % 3 else [(x / 300, 0.1, 0.9), (0.9, 0.3, 0.8)]) for s, i, x, *_ in rows]
    path = str(tmp_path / "in")
    for k in range(4):
        spark.createDataFrame([r for r in rows if max(0, 10 * k - 3) <= r[1] < 10 * k + 10], schema).coalesce(1).write.mode("append").parquet(path)
        src = spark.readStream.schema(schema).parquet(path)
        for name, out in (("ema", online.ema(src)), ("segments", online.segment_by_median(src, 607.0, 2.0)), ("hysteresis", online.hysteresis(src, needed=2))):
            def take(batch, _, name=name):
                got = [tuple(r) for r in batch.collect()]
                assert not seen[name] & set(got) and len(set(got)) == len(got)
                seen[name] |= set(got)

            writer = out.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True)
            writer.start().awaitTermination()
    whole = spark.createDataFrame(rows, schema)
    near = lambda rows: sorted((*r[:2], round(r[2], 9)) for r in rows)
    assert near(seen["ema"]) == near(map(tuple, tracking.ema_series(whole).collect()))
    assert near(seen["hysteresis"]) == near(map(tuple, tracking.hysteresis(whole, needed=2).collect()))
    full = {(r.source_id, r.start_idx, r.end_idx, r.crop_x) for r in tracking.segment_by_median(whole, 607.0, 2.0).collect()}
    assert seen["segments"] <= full and len(full - seen["segments"]) == 2


def test_dedup_emits_when_the_watermark_passes(spark, tmp_path):
    """A source that falls silent gives its last hit once other sources' time has gone on; what comes too late goes."""
    batches = [[(1, 0, 0.0, 5.0, 0, 0.5), (1, 1, 0.0, 9.0, 1, 0.9)], [(2, 0, 0.0, 100.0, 2, 0.1)], [(1, 2, 0.0, 20.0, 3, 1.0), (2, 1, 0.0, 101.0, 4, 0.2)]]
    src = stream_of(spark, tmp_path, batches, SCHEMA)
    got = collect(spark, tmp_path, online.near_dedup(src, 30.0, "10 seconds"), "timed").collect()
    assert [(r.source_id, r.hit_id) for r in got] == [(1, 1)]


def test_running_median_of_a_long_segment():
    import time

    rng = random.Random(1)
    values = [rng.random() for _ in range(1001)]
    held = streams.RunningMedian()
    for i, x in enumerate(values, 1):
        held.add(x)
        assert held.middle() == statistics.median(values[:i])
    began, machine = time.time(), streams.Segmenter(10.0, 3)
    for i in range(1_000_000):
        machine.step(float(i % 2))
    assert time.time() - began < 30 and machine.length == 1_000_000


def test_face_machines(spark, tmp_path):
    rng = random.Random(4)
    face = lambda: {"cx": rng.random() * 1920, "cy": 500.0, "w": 200.0, "h": 300.0, "score": rng.random()}
    schema = "source_id long, idx long, faces array<struct<cx:double,cy:double,w:double,h:double,score:double>>"
    rows = [(1, i, [face() for _ in range(rng.randrange(3))]) for i in range(30)]
    src, whole = stream_of(spark, tmp_path, [rows[:11], rows[11:]], schema), spark.createDataFrame(rows, schema)
    got = sorted(tuple(r) for r in collect(spark, tmp_path, online.track_with_recovery(src, 1920.0, 1080.0, 1.0), "rec").collect())
    assert got == sorted(tuple(r) for r in tracking.track_with_recovery(whole, 1920.0, 1080.0, 1.0).collect())
    got = sorted(tuple(r) for r in collect(spark, tmp_path, online.hysteresis(src, jump=100.0, agree=400.0, needed=2, wide_gap=500.0), "hys").collect())
    assert got == sorted(tuple(r) for r in tracking.hysteresis(whole, jump=100.0, agree=400.0, needed=2, wide_gap=500.0).collect())


def test_windowed_energy(spark, tmp_path):
    rows = [(1, i / 4, 3.0 if i < 4 else 1.0) for i in range(40)]
    src = stream_of(spark, tmp_path, [rows[:20], rows[20:]], "source_id long, t double, amp double").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.window.start.second: r.rms for r in collect(spark, tmp_path, online.tumbling_energy(src, "0 seconds"), "en").collect()}
    assert got[0] == 3.0 and got[1] == 1.0
    assert collect(spark, tmp_path, online.sliding_passages(src, "0 seconds", "4 seconds", "2 seconds"), "sl").count() > 0


def test_neighbouring_sources_share_state_calls(spark):
    """A micro-batch of 16 sources costs a few calls of the state store, not some for each source."""
    calls = []

    class Store:
        rows = []

        def get(self):
            calls.append("get")
            return iter(self.rows)

        def put(self, rows):
            calls.append("put")
            self.rows = [tuple(r) for r in rows]

        def getListState(self, *_):
            return self

        def registerTimer(self, at):
            calls.append(("register", at - online.ORIGIN_MS))

        def deleteTimer(self, at):
            calls.append(("delete", at - online.ORIGIN_MS))

    class Now:
        def getCurrentWatermarkInMs(self):
            return self.at + online.ORIGIN_MS

        getExpiryTimeInMs = getCurrentWatermarkInMs

        def __init__(self, at):
            self.at = at

    order = {"start_s": "double", "hit_id": "long", "score": "double"}
    pack = online.Deduplicator(lambda: streams.NearTime(30.0), lambda m, r: [x for x in [m.step(r.start_s, r.hit_id, r.score)] if x], order, ["source_id", "start_s", "hit_id", "score"])
    store = Store()
    pack.init(store)
    row = online.Row("source_id", "start_s", "hit_id", "score")
    assert list(pack.handleInputRows((0,), iter([row(s, 10.0 + s, s, 0.5) for s in reversed(range(16))]), Now(0))) == []
    assert calls == ["get", "put", ("register", 40_000)]
    calls.clear()
    got = list(pack.handleInputRows((0,), iter([row(0, 11.0, 99, 0.9), row(1, 45.0, 98, 0.1), row(1, 45.0, 98, 0.1)]), Now(20_000)))
    assert [tuple(r) for r in got] == [(1, 11.0, 1, 0.5)] and calls == ["get", "put", ("delete", 40_000), ("register", 41_000)]
    calls.clear()
    got = list(pack.handleExpiredTimer((0,), Now(50_000), Now(41_000)))
    assert sorted(r.source_id for r in got) == [0, *range(2, 11)] and got[0].hit_id in range(100)
    assert calls == ["get", "put", ("register", 51_000)]

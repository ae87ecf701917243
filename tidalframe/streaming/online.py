"""Structured Streaming twins of the online operators.

Each source is a state machine whose state is typed columns in the state store, so it can be read
across versions and a restart goes on where the last checkpoint was. Machines of bounded state are
kept in packs of neighbouring ids, a row each; one whose list grows has a key of its own. Rows of a micro-batch are
sorted by the machine's order; rows that are not after the last one a source has taken are
late (or sent twice) and go. Cut into any micro-batches, a stream whose sources arrive in order
gives the batch result. Near-time dedup also runs on event time: a kept hit comes out when the
watermark passes its start and the gap. The queries need the RocksDB state store, which ``drained``
sets for its query.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.streams import Ema, Hysteresis, NearTime, Recovery, Segmenter
from ..scratch import remove, scratch

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Second 0 of a timeline as an event time (ms): event times at or before 1970 count as late from the start.
ORIGIN_MS = 10**12
#: Neighbouring ids whose machines share a key of the state, a power of two.
PACK = 16


def replay(rows: DataFrame, order: str, slices: int = 4, files: int = 2) -> DataFrame:
    """A bounded table as a stream of ``slices`` micro-batches, cut by equal steps of ``order``.

    Most sources are cut by several slices; of a slice a source is in one file.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "replay")
    place = F.col(order).cast("double")
    low, high = rows.agg(F.min(place), F.max(place)).first()
    at = F.least(F.floor((place - F.lit(low)) / F.lit(max((high or 0.0) - (low or 0.0), 1e-9)) * slices), F.lit(slices - 1))
    for k in range(slices):  # one after the other: a stream reads older files first
        rows.where(at == k).repartition(files, "source_id").write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives once all its input has come, as a table (the last state for ``complete``)."""
    spark = stream.sparkSession
    path, progress = scratch(spark, "drained"), scratch(spark, "progress")
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True)
        if mode == "complete":
            query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
        else:
            query = writer.format("parquet").option("path", path).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    remove(spark, progress)
    return spark.read.schema(stream.schema).parquet(path)


class Machine(StatefulProcessor):
    """A state machine for each source: ``step(machine, row)`` gives output tuples.

    ``order`` names the columns, with types, by which rows are taken.
    """

    def __init__(self, make: Callable, step: Callable, order: dict[str, str], names: list[str]):
        self.make, self.step, self.order, self.names = make, step, order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = self.make()
        places = ", ".join(f"at_{c} {t}" for c, t in self.order.items())
        self.handle, self.size = handle, len(kind.STATE.split(","))
        self.state = handle.getValueState("machine", f"{kind.STATE}, {places}")
        self.listed = handle.getListState("listed", f"x {kind.LIST}") if kind.LIST else None

    def load(self):
        """(machine, place of its last row, numbers in its list)"""
        held, machine = self.state.get(), self.make()
        if held is None:
            return machine, None, 0
        numbers = [x[0] for x in self.listed.get()] if self.listed else []
        return machine.restored(tuple(held[: self.size]), numbers), tuple(held[self.size :]), len(numbers)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        machine, last, kept = self.load()
        first = machine.listed[0] if kept else None
        whole = True  # the list has only grown
        for out in self.due(machine, timerValues) if last is not None else ():
            yield Row(**dict(zip(self.names, (key[0], *out), strict=True)))
        for place, row in sorted(((tuple(r[c] for c in self.order), r) for r in rows), key=lambda x: x[0]):
            if last is not None and place <= last:
                continue
            last = place
            for out in self.step(machine, row):
                whole = False
                yield Row(**dict(zip(self.names, (key[0], *out), strict=True)))
        if last is None:
            return
        self.state.update((*machine.saved(), *last))
        if self.listed:
            now = machine.listed
            if isinstance(machine, Segmenter) and whole and first is not None:  # a long open segment is not written again
                if fresh := now[kept:]:
                    self.listed.appendList([(x,) for x in fresh])
            elif now:
                self.listed.put([(x,) for x in now])
            else:
                self.listed.clear()
        self.taken(machine)

    def due(self, machine, timerValues) -> list[tuple]:
        """What comes out before a micro-batch's rows, by time alone."""
        return []

    def taken(self, machine) -> None:
        """After a micro-batch of a source."""

    def close(self) -> None:
        pass


class Pack(Machine):
    """The machines of a run of ``PACK`` ids, a row of the state each, under one key.

    What Spark does for a key (state calls, an Arrow batch of outputs) costs far more than a
    source's few rows in a micro-batch, so neighbours share it. ``step`` and its outputs stay a source's.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = self.make()
        places = ", ".join(f"at_{c} {t}" for c, t in self.order.items())
        numbers = f", listed array<{kind.LIST}>" if kind.LIST else ""
        self.handle, self.size, self.lists = handle, len(kind.STATE.split(",")), bool(kind.LIST)
        self.state, self.row = handle.getListState("machines", f"source_id long, {kind.STATE}, {places}{numbers}"), Row(*self.names)

    def load(self) -> dict:
        """(machine, place of its last row) by source"""
        held, end = {}, 1 + self.size + len(self.order)
        for row in self.state.get():
            held[row[0]] = self.make().restored(tuple(row[1 : 1 + self.size]), row[end] if self.lists else ()), tuple(row[1 + self.size : end])
        return held

    def save(self, held: dict) -> None:
        self.state.put([(source, *m.saved(), *last, *([m.listed] if self.lists else ())) for source, (m, last) in held.items()])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, dealt = self.load(), {}
        waits = self.waits(held)
        for r in rows:
            dealt.setdefault(r["source_id"], []).append((tuple([r[c] for c in self.order]), r))
        for source, own in dealt.items():
            machine, last = held.get(source) or (self.make(), None)
            for out in self.due(machine, timerValues) if last is not None else ():
                yield self.row(source, *out)
            own.sort(key=lambda x: x[0])
            for place, row in own:
                if last is not None and place <= last:
                    continue
                last = place
                for out in self.step(machine, row):
                    yield self.row(source, *out)
            held[source] = machine, last
        self.save(held)
        self.wait(waits, self.waits(held))

    def waits(self, held: dict) -> int | None:
        """When (ms) the first of these machines has to be woken."""
        return None

    def wait(self, before: int | None, now: int | None) -> None:
        """The pack's one timer, moved if it was set for another time."""
        if before != now:
            if before is not None:
                self.handle.deleteTimer(before)
            if now is not None:
                self.handle.registerTimer(now)


class Deduplicator(Pack):
    """Near-time dedup with a timer for the moment at which a kept hit can no longer be replaced:
    the first such moment of the pack."""

    def at(self, machine: NearTime) -> int:
        return ORIGIN_MS + math.ceil((machine.last[0] + machine.gap) * 1000)

    def waits(self, held: dict) -> int | None:
        return min((self.at(m) for m, _ in held.values() if m.open), default=None)

    def due(self, machine: NearTime, timerValues) -> list[tuple]:
        done = machine.expire((timerValues.getCurrentWatermarkInMs() - ORIGIN_MS) / 1000)
        return [] if done is None else [done]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.load()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        for source, (machine, _) in held.items():
            if machine.open and self.at(machine) <= now:
                yield self.row(source, *machine.expire(math.inf))
        self.save(held)
        self.wait(None, self.waits(held))  # the timer that rang goes by itself


def _packed(rows: DataFrame):
    """``rows`` by runs of ids."""
    return rows.withColumn("__pack", F.shiftright("source_id", PACK.bit_length() - 1)).groupBy("__pack")


def _machine(rows: DataFrame, make: Callable, step: Callable, schema: str, order: dict[str, str] | None = None) -> DataFrame:
    """A source's outputs; the machine's rows are ordered by idx unless said otherwise."""
    names = [c.split()[0] for c in schema.split(", ")]
    kind, dealt = (Machine, rows.groupBy("source_id")) if make().LIST and make().GROWS else (Pack, _packed(rows))
    return dealt.transformWithState(kind(make, step, order or {"idx": "long"}, names), schema, "append", "None")


def ema(rows: DataFrame, alpha: float = 0.92) -> DataFrame:
    return _machine(rows, lambda: Ema(alpha), lambda m, r: [(r.idx, m.step(r.x))], "source_id long, idx long, ema double")


def hysteresis(samples: DataFrame, **params) -> DataFrame:
    return _machine(samples, lambda: Hysteresis(**params), lambda m, r: [(r.idx, m.step(_faces(r.faces)))], "source_id long, idx long, target double")


def track_with_recovery(frames: DataFrame, width: float, height: float, fps: float, **params) -> DataFrame:
    return _machine(frames, lambda: Recovery(width, height, fps, **params), lambda m, r: [(r.idx, m.step(_faces(r.faces)))], "source_id long, idx long, crop_x long")


def segment_by_median(rows: DataFrame, crop_w: float, fps: float, k: float = 0.15, src_w: int | None = None) -> DataFrame:
    """Closed segments; the open one stays in the state."""
    most = None if src_w is None else int(src_w - crop_w)

    def step(m: Segmenter, r) -> list[tuple]:
        done = m.step(float(r.x))
        return [] if done is None else [done]

    return _machine(rows, lambda: Segmenter(k * crop_w, int(1.5 * fps), most), step, "source_id long, start_idx long, end_idx long, crop_x long")


def near_dedup(hits: DataFrame, gap: float = 30.0, late: str = "10 seconds") -> DataFrame:
    """Kept hits, each once a hit ``gap`` or more after it has come or the watermark (``late``
    behind the latest start of all sources) has passed its start and the gap."""

    def step(m: NearTime, r) -> list[tuple]:
        done = m.step(r.start_s, r.hit_id, r.score)
        return [] if done is None else [done]

    schema = "source_id long, start_s double, hit_id long, score double"
    order = {"start_s": "double", "hit_id": "long", "score": "double"}
    machine = Deduplicator(lambda: NearTime(gap), step, order, [c.split()[0] for c in schema.split(", ")])
    timed = hits.withColumn("__time", F.timestamp_millis(F.floor(F.col("start_s") * 1000) + ORIGIN_MS)).withWatermark("__time", late)
    return _packed(timed).transformWithState(machine, schema, "append", "EventTime")


def _faces(faces) -> list:
    return [] if faces is None else [f if isinstance(f, dict) else f.asDict() for f in faces]


def tumbling_energy(samples: DataFrame, late: str = "10 seconds", width: str = "1 second") -> DataFrame:
    """RMS of tumbling windows over (ts, source_id, amp)."""
    kept = samples.withWatermark("ts", late)
    return kept.groupBy(F.window("ts", width), "source_id").agg(F.sqrt(F.avg(F.col("amp") * F.col("amp"))).alias("rms"), F.count(F.lit(1)).alias("n"))


def sliding_passages(samples: DataFrame, late: str = "10 seconds", width: str = "30 seconds", slide: str = "20 seconds") -> DataFrame:
    """Counts and RMS of overlapping windows (no sentence snap)."""
    kept = samples.withWatermark("ts", late)
    return kept.groupBy(F.window("ts", width, slide), "source_id").agg(F.sqrt(F.avg(F.col("amp") * F.col("amp"))).alias("rms"), F.count(F.lit(1)).alias("n"))

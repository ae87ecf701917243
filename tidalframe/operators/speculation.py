"""State machines over long sources, chunk by chunk.

A chunk first runs from a guess: the state that a fresh machine reaches over the chunk before it.
Then every chunk whose entry is not its predecessor's exit runs again from that exit, until none
is left. The first chunk's entry is right, so when all agree all are right, whatever the guesses were; if
states never meet, a chunk is settled a round. Chunks run side by side, and of a chunk only entry
and exit, as text, meet by source. Rows need a dense idx from 0.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..scratch import staged

CHUNK = 4096
KEYS = ["source_id", "__chunk"]


def _text(machine) -> str:
    return json.dumps([machine.saved(), list(getattr(machine, "listed", ()))])


def _machine(make, text: str, idx: int):
    state, listed = json.loads(text)
    return make(idx).restored(tuple(state), listed)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _sorted(rows: DataFrame, entries: DataFrame | None) -> DataFrame:
    """Rows of (source_id, __chunk), each chunk begun by a row that holds its entry, if known."""
    dealt = rows.withColumn("__entry", F.lit(None).cast("string"))
    if entries is not None:
        dealt = dealt.unionByName(entries.select(*KEYS, F.lit(-1).cast("long").alias("idx"), F.col("entry").alias("__entry")), allowMissingColumns=True)
    columns = [c for c in dealt.columns if c not in (*KEYS, "idx", "__entry")]
    return dealt.select(*KEYS, "idx", "__entry", *columns).repartition(*KEYS).sortWithinPartitions(*KEYS, "idx")


def _exits(dealt: DataFrame, chunk: int, make, step) -> DataFrame:
    """(source_id, __chunk, entry, exit) of each chunk; rows before the chunk warm the machine up."""
    schema = T.StructType([*[dealt.schema[k] for k in KEYS], T.StructField("entry", T.StringType()), T.StructField("exit", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        key, machine, entry = None, None, None
        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != key:
                    if key is not None:
                        done.append((*key, entry, _text(machine)))
                    key, machine, entry = row[:2], None, None
                if row[3] is not None:
                    machine, entry = _machine(make, row[3], row[1] * chunk), row[3]
                    continue
                machine = machine or make(row[2])
                if entry is None and row[2] >= row[1] * chunk:
                    entry = _text(machine)
                step(machine, *row[2:3], *row[4:])
            yield _batch(done, arrow)
        if key is not None:
            yield _batch([(*key, entry, _text(machine))], arrow)

    return dealt.mapInArrow(run, schema)


def _outputs(dealt: DataFrame, chunk: int, make, step, finish, schema: T.StructType, last: DataFrame) -> DataFrame:
    """What the machines give, from each chunk's true entry; ``last`` chunks are finished."""
    arrow = to_arrow_schema(schema)
    ends = dealt.join(last.withColumn("__ends", F.lit(True)), KEYS, "left").select(*KEYS, "idx", "__entry", "__ends", *dealt.columns[4:])

    def run(batches):
        key, machine, ends_here = None, None, False
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != key:
                    if ends_here and finish:
                        out += [(key[0], *x) for x in finish(machine)]
                    key, ends_here = row[:2], bool(row[4])
                    machine = _machine(make, row[3], row[1] * chunk)
                    continue
                out += [(key[0], *x) for x in step(machine, row[2], *row[5:])]
            yield _batch(out, arrow)
        if ends_here and finish:
            yield _batch([(key[0], *x) for x in finish(machine)], arrow)

    return ends.repartition(*KEYS).sortWithinPartitions(*KEYS, "idx").mapInArrow(run, schema)


def chunked(rows: DataFrame, columns: list[str], make, step, schema: str, chunk: int = CHUNK, finish=None) -> DataFrame:
    """Outputs (source_id, then ``schema``) of a machine over each source's rows by idx.

    ``make(idx)`` gives a fresh machine for a run that begins at idx, ``step(machine, idx, *columns)`` its
    outputs, ``finish(machine)`` those at a source's end.
    """
    rows = rows.select("source_id", F.col("idx").cast("long").alias("idx"), *columns).withColumn("__chunk", F.floor(F.col("idx") / chunk))
    rows = staged(rows, "chunks")
    warm = rows.withColumn("__chunk", F.col("__chunk") + 1)
    exist = rows.select(*KEYS).distinct()
    guessed = rows.unionByName(warm.join(exist, KEYS, "left_semi"))
    table = staged(_exits(_sorted(guessed, None), chunk, make, step), "entries")
    while True:
        before = F.lag("exit").over(Window.partitionBy("source_id").orderBy("__chunk"))
        told = table.withColumn("due", before)
        wrong = staged(told.where("due is not null and due <> entry").select(*KEYS, F.col("due").alias("entry")), "wrong-entries")
        if not wrong.limit(1).count():
            break
        again = _exits(_sorted(rows.join(wrong.select(*KEYS), KEYS, "left_semi"), wrong), chunk, make, step)
        table = staged(table.join(wrong.select(*KEYS), KEYS, "left_anti").unionByName(again), "entries")
    out = T.StructType([rows.schema["source_id"], *T.StructType.fromDDL(schema).fields])
    last = table.groupBy("source_id").agg(F.max("__chunk").alias("__chunk"))
    return _outputs(_sorted(rows, table.select(*KEYS, "entry")), chunk, make, step, finish, out, last)

"""The training-data queries with SQL against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from tidalframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    want = con.execute(ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    rows = sorted(tuple(dict(zip((d[0] for d in want.description), r, strict=True))[c] for c in columns) for r in want.fetchall())
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == rows

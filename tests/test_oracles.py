"""Every query with an oracle against DuckDB on the same tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tidalframe.plans.oracles import ORACLES
from tidalframe.plans.queries import QUERIES


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def rows_of(frame):
    def plain(v):
        if pd.isna(v):
            return None
        return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, db, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), db.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_flagship_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20

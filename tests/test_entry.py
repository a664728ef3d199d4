"""Every registered query that has SQL against DuckDB, on the smallest data."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else repr(round(float(v), 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return v.isoformat() if isinstance(v, (datetime.datetime, datetime.date)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    want = duck.sql(entry.oracle_sql()[name])
    cols, at = sorted(df.columns), {c: i for i, c in enumerate(want.columns)}
    assert cols == sorted(at)
    key = lambda rows: sorted((str(r) for r in rows))
    assert key([norm(r[c]) for c in cols] for r in df.collect()) == key([norm(r[at[c]]) for c in cols] for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every query that has SQL gives what DuckDB gives on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    if isinstance(value, bool) or not hasattr(value, "__float__"):
        return str(value)
    return repr(round(float(value), 7) + 0.0)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in data)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    df = entry.queries()[name](spark, DATA)
    result = tables.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0

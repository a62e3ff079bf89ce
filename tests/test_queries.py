"""Every query of the reference's own operators against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from stillmark.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return str(value)


def same_rows(spark, duck, query, sql):
    got = query(spark, DATA)
    columns = sorted(got.columns)
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in got.collect()) == want


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    if name not in ORACLES:
        assert QUERIES[name](spark, DATA).count() >= 0
    else:
        same_rows(spark, duck, QUERIES[name], ORACLES[name])


def test_flagship_query(spark):
    assert __spark_entry__.entry(spark).count() > 0

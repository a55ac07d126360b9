"""Every registered query runs, and equals its SQL in DuckDB where it has one."""

import math
import os
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as job

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = job.queries(), job.oracle_sql()
OWN = sorted(n for n in QUERIES if not re.match(r"op\d+_", n) and n != "pipeline")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    if name in SQL:
        result = duck.execute(SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, result.fetchall())


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, duck, name):
    compare(spark, duck, name)


def test_entry(spark):
    assert job.entry(spark).columns


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)

"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from lexmill.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, float):
        return f"{value:.6g}" if value else "0"
    if isinstance(value, datetime.datetime):
        return value.isoformat(" ")[:19]
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    run, sql = QUERIES[name]
    frame = run(spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    if sql is None:
        assert got
        return
    cursor = duck.execute(sql)
    described = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(described) == columns
    assert {c: TYPES[t] for c, t in frame.dtypes} == described
    names = list(described)
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want

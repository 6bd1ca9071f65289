"""Every library query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from fieldloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows_of(columns, rows):
    return sorted((tuple(str(plain(r[columns.index(c)])) for c in sorted(columns)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    got = plans.queries()[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    assert rows, "a query that finds nothing shows nothing"
    sql = plans.oracle_sql().get(name)
    if sql is None:
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == sorted(got.columns)
    assert rows_of(got.columns, rows) == rows_of(want.columns, want.fetchall())

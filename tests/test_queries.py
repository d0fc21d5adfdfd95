"""Every registered lake query against its SQL in DuckDB."""

import decimal
import os

import duckdb
import pytest

from tidelake import queries as lake

from .conftest import SMALL


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.split('.')[0]} as from '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(lake.QUERIES))
def test_query(spark, duck, name):
    df = lake.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    rows = sorted([str(plain(r[c])) for c in columns] for r in df.collect())
    if name not in lake.SQL:
        assert rows
        return
    result = duck.execute(lake.SQL[name])
    there = [d[0] for d in result.description]
    assert columns == sorted(there)
    assert rows == sorted([str(plain(r[there.index(c)])) for c in columns] for r in result.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

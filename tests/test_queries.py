"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import datetime
import decimal
import math

import duckdb
import pytest

from veriloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{FOLDER}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, FOLDER)
    got = sorted((tuple(plain(r[c]) for c in sorted(found.columns)) for r in found.collect()), key=repr)
    if name in registry.ORACLES:
        answer = duck.sql(registry.ORACLES[name])
        columns = answer.columns
        assert sorted(columns) == sorted(found.columns)
        assert got == sorted((tuple(plain(x) for _, x in sorted(zip(columns, r))) for r in answer.fetchall()), key=repr)
    else:
        assert found.columns

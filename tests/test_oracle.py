"""Every query with SQL gives what an independent engine gives on the same tables."""

import datetime
import decimal

import duckdb
import pytest

from noticelake import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{FOLDER}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    return value.isoformat() if isinstance(value, (datetime.date, datetime.datetime)) else value


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    found = catalog.queries()[name](spark, FOLDER)
    names = sorted(found.columns)
    mine = sorted((tuple(plain(row[n]) for n in names) for row in found.collect()), key=repr)
    result = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    other = sorted((tuple(plain(row[i]) for i in at) for row in result.fetchall()), key=repr)
    assert mine == other


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows_only(spark, name):
    assert catalog.queries()[name](spark, FOLDER).limit(5).collect()

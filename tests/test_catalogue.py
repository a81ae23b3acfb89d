"""Every registered query of the engine against its SQL at the smallest scale."""

import decimal
import os

import duckdb
import pytest

from paginal.queries import flagship, oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, decimal.Decimal):
        return int(v)
    return v


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, db, name):
    df = queries()[name](spark, SF)
    found = db.execute(oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    assert got == want


def test_all_have_sql():
    assert set(queries()) == set(oracle_sql())


def test_flagship(spark):
    assert flagship(spark, SF).count() > 0

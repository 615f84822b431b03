"""Every registered query with an SQL twin agrees with it, at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as e

DATA = "/root/testdata/sf0.001"
SQL = e.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for f in os.listdir(DATA):
        c.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return c


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        return v.item() if hasattr(v, "item") else v

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)


def test_every_query_is_named_once():
    assert set(SQL) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    mine, theirs = e.queries()[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_entry(spark):
    assert e.entry(spark).columns == ["a", "b", "distance"]

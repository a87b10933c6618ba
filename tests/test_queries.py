"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from queries.check import TABLES, normal


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, sf_dir, name):
    df = contract.queries()[name](spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    sql = contract.oracle_sql().get(name)
    if sql is not None:
        result = duck.execute(sql)
        assert got == normal([c[0] for c in result.description], result.fetchall())


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert {r["class"] for r in rows} == {"0", "1"}


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())

"""Every registered query against its oracle over the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import rows_of
from workload import registry
from workload.inputs import BASE

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables missing")
# Queries without SQL are compared with plain versions in tests of their own.
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in BASE:
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    theirs = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(theirs.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(theirs.columns, theirs.fetchall())


def test_entry_runs(spark):
    assert not entry.entry(spark).isEmpty()

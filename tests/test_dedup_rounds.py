"""The way of large jobs against its oracle, over tables whose jobs are large enough to take it."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from leadlake.operators import dedup
from tools.check import rows_of
from workload.inputs import BASE

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables missing")


def test_rounds_equal_the_oracle(spark, monkeypatch):
    sizes, plain = [], dedup.greedy_keep
    monkeypatch.setattr(dedup, "greedy_keep", lambda keyed, scope, order, group_rows, largest: sizes.append((largest or keyed.groupBy(scope).count().agg({"count": "max"}).first()[0], group_rows)) or plain(keyed, scope, order, group_rows, largest))
    con = duckdb.connect()
    for name in BASE:
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    df = entry.queries()["f2_dedup_leads_rounds"](spark, SF)
    theirs = con.sql(entry.oracle_sql()["f2_dedup_leads_rounds"])
    assert rows_of(df.columns, df.collect()) == rows_of(theirs.columns, theirs.fetchall())
    assert sizes and all(largest > group_rows for largest, group_rows in sizes)

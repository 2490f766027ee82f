"""The corpus queries against their SQL, and that each runs on the smallest tables."""
import glob
import os

import duckdb
import pytest

from sparkloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    frame, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in frame.columns]
    assert sorted(map(repr, map(tuple, frame.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0

"""Queries against their SQL, whole tables."""

import glob
import os

import duckdb
import pytest

from lectern.llm import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = Q.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.sql(Q.oracle_sql()[name])
    assert sorted(want.columns) == cols
    assert sorted(map(repr, want.select(*(f'"{c}"' for c in cols)).fetchall())) == sorted(repr(tuple(r)) for r in df.select(*cols).collect())

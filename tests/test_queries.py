import glob
import os

import duckdb
import pytest

from lectern.plans import queries as Q

DATA = "/root/testdata/sf0.001"


def key(row):
    return tuple("~" if x is None else repr(round(x, 6)) if isinstance(x, float) else repr(x) for x in row)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, duck, name):
    df = Q.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(key(r) for r in df.select(*cols).collect())
    if name in Q.oracle_sql():
        want = duck.sql(Q.oracle_sql()[name])
        assert sorted(want.columns) == cols
        assert sorted(key(r) for r in want.select(*(f'"{c}"' for c in cols)).fetchall()) == rows


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_groups_in_order(spark, duck):
    got = [r.relative_path for r in Q.queries()["duplicates_in_order"](spark, DATA).collect()]
    assert len(got) > 10 and got == [r[2] for r in duck.sql(Q.oracle_sql()["duplicates_in_order"]).fetchall()]


def test_every_query_has_sql():
    assert set(Q.queries()) == set(Q.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_whole_corpus_in_order(spark, duck):
    got = [r.question_id for r in Q.queries()["corpus_order"](spark, DATA).collect()]
    assert len(got) > 50 and got == [r[0] for r in duck.sql(Q.oracle_sql()["corpus_order"]).fetchall()]

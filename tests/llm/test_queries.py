"""Every query of ``llm`` that has SQL, at the smallest scale, row by row; the others run."""

import os

import pytest

import compare
from passageworks.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = QUERIES[name](spark, DATA)
    found = con.execute(ORACLE[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    mine, theirs = compare.rows(df.columns, df.collect()), compare.rows(names, found.fetchall())
    assert mine == theirs or compare.same(mine, theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).limit(5).count() >= 0

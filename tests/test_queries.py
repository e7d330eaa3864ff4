"""Every registered query of the core that has SQL, at the smallest scale, row by row."""

import datetime
import os

import pytest

import compare
from passageworks import plans

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_equals_sql(spark, con, name):
    df = plans.QUERIES[name](spark, DATA)
    found = con.execute(plans.ORACLE[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    mine, theirs = compare.rows(df.columns, df.collect()), compare.rows(names, found.fetchall())
    assert mine == theirs or compare.same(mine, theirs)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, DATA).limit(5).count() >= 0


def test_traces_are_read_again_as_they_were(spark, tmp_path):
    """Microseconds, texts beyond the parser's usual bound and numbers that JSON does not know."""
    time = datetime.datetime(2031, 1, 1, 1, 2, 3)
    inputs = [(time.replace(microsecond=m), v, "a") for m, v in ((123456, float("nan")), (1, float("inf")), (999999, -0.0), (120000, 0.1 + 0.2), (0, None))] + [(time, 1.0, "x" * 20_000_001)]
    hit = "array<struct<rank: int, chunk_id: string, text: string, score: double>>"
    schema = f"trace_id long, query string, retrieved {hit}, reranked {hit}, answer string, latency_ms map<string, double>, wall_time map<string, timestamp_ntz>"
    rows = [(i, "q", [(1, "c", "t", v)], [(1, "c", "t", v)], text, {"retrieve": v}, {"pipeline_start": t}) for i, (t, v, text) in enumerate(inputs)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/run_traces.parquet")
    df = plans.QUERIES["trace_struct"](spark, str(tmp_path))
    con = duckdb.connect()
    for name, path in (("run_traces", f"{tmp_path}/run_traces.parquet/*.parquet"), ("qa_samples", f"{DATA}/qa_samples.parquet")):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    found = con.execute(plans.ORACLE["trace_struct"])
    assert df.columns == [c[0] for c in found.description]
    # by their text, so that NaN is itself and no null
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, found.fetchall()))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the test tables are not here")
def test_trained_index_reaches_its_recall(spark):
    d = "/root/testdata/sf0.1"
    assert plans.QUERIES["ivf_recall"](spark, d).first()["recall"] >= 0.9
    exact, found = ({(r["qid"], r["did"]) for r in plans.QUERIES[name](spark, d).where("rk <= 10").collect()} for name in ("dense_topk_cosine", "index_roundtrip"))
    assert len(exact & found) >= 0.9 * len(exact)

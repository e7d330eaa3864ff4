import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passageworks.llm import percentiles as P

Q = [0.0, 0.5, 0.9, 0.95, 0.99, 1.0]


def table(spark, groups):
    rows = [(g, v, 1.5, "clash") for g, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "g string, v double, n double, lo string").repartition(3)


GROUPS = {
    "ties": [0.0] * 70 + [1.0] * 30,
    "one": [5.0],
    "two": [1.0, 2.0],
    "signs": [-1e9, -3.0, -3.0, -0.0, 0.0, 1e-12, 7.0, 1e12],
    "wide": [10.0**e for e in range(-300, 301, 7)] + [-(10.0**e) for e in range(-300, 301, 11)],
    "near": [1 + i * 2.0**-52 for i in range(40)],
    "tail": np.random.default_rng(1).pareto(1.0, 500).tolist(),
    "dirty": [None, math.nan, 3.0, None, 4.0],
    "nothing": [None, math.nan],
    None: [2.0, 4.0],
}


@pytest.mark.parametrize("fanout", [2, 256])
def test_exact(spark, fanout):
    groups = GROUPS if fanout > 2 else {k: GROUPS[k] for k in ("ties", "two", "dirty", "nothing", None)}
    got = {r["g"]: r for r in P.exact_percentiles(table(spark, groups), ["g"], "v", Q, fanout).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        own = [v for v in values if v is not None and not math.isnan(v)]
        assert got[g]["n"] == len(own)
        for q in Q:
            x = got[g][P._name(q)]
            assert x is None if not own else x == pytest.approx(float(np.percentile(own, q * 100)), rel=1e-12), (g, q)


def test_intervals_that_are_joined_give_the_same(spark, monkeypatch):
    groups = {k: GROUPS[k] for k in ("ties", "signs", "wide", "dirty", None)}
    key = lambda r: repr(r["g"])
    broadcast = sorted(P.exact_percentiles(table(spark, groups), ["g"], "v", Q).collect(), key=key)
    monkeypatch.setattr(P, "BROADCAST_ROWS", 0)
    assert sorted(P.exact_percentiles(table(spark, groups), ["g"], "v", Q).collect(), key=key) == broadcast


def test_infinities_and_no_keys(spark):
    rows = table(spark, {"a": [-math.inf, -math.inf, 1.0, math.inf], "b": [math.inf] * 3})
    got = {r["g"]: r for r in P.exact_percentiles(rows, ["g"], "v", [0.0, 0.5, 1.0]).collect()}
    assert got["a"]["p0"] == -math.inf and got["a"]["p50"] == -math.inf and got["a"]["p100"] == math.inf
    assert got["b"]["p50"] == math.inf
    whole = P.exact_percentiles(rows.where("g = 'b'").limit(0), [], "v", [0.5]).collect()
    assert whole == []
    assert P.exact_percentiles(rows.limit(0), ["g"], "v", [0.5]).count() == 0
    assert P.exact_percentiles(table(spark, {"a": [1.0, 2.0, 3.0]}), [], "v", [0.5]).collect()[0]["p50"] == 2.0


def test_summaries_combine(spark):
    rng = np.random.default_rng(2)
    values = [float(x) for x in np.r_[rng.lognormal(3, 2, 4000), -rng.lognormal(1, 1, 500), [0.0] * 50, [math.inf]]] + [None, math.nan]
    rows = spark.createDataFrame([(f"d{i % 7}", v) for i, v in enumerate(values)], "day string, v double")
    daily = P.summarise(rows, ["day"], "v")
    assert daily.agg(F.sum("n")).first()[0] == len(values) - 2
    merged = P.merge(daily, [])
    together = P.summarise(rows, [], "v")
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, together.select(*merged.columns).collect()))
    got = P.summary_percentiles(daily, [], [0.05, 0.5, 0.95]).first()
    own = [v for v in values if v is not None and not math.isnan(v)]
    for q in (0.05, 0.5, 0.95):
        true = float(np.percentile(own, q * 100))
        assert abs(got[P._name(q)] - true) <= abs(true) * 2.0 ** -(P.SUMMARY_BITS + 1) * 1.05 + 1e-9


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=40))
def test_any_values(spark, values):
    got = P.exact_percentiles(table(spark, {"x": values}), ["g"], "v", [0.0, 1.0]).first()
    assert (got["p0"], got["p100"]) == (min(values), max(values))

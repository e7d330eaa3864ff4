"""Reports over traces and labels: retrieval, reranking, generation, latency, and their comparison."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passageworks.functions.text import has_answer, normalise, strip
from passageworks.operators.embed import Embedder


def relevance(texts: Column, answers: Column | str) -> Column:
    """One boolean per retrieved text: whether it contains a gold answer, as ``with_labels`` gives them (normalised once for all hits)."""
    return F.transform(texts, lambda t: has_answer(F.coalesce(t, F.lit("")), answers, normalised=True))


def _gain(relevant: Column) -> Column:
    return F.aggregate(F.transform(relevant, lambda r, i: F.when(r, 1.0).otherwise(0.0) / F.log2(i + 2)), F.lit(0.0), lambda s, x: s + x)


def _count(relevant: Column) -> Column:
    return F.size(F.filter(relevant, lambda x: x))


def retrieval_metrics(relevant: Column | str, k: int) -> dict[str, Column]:
    """precision, recall (of the pool), rr (whole list), hit and ndcg of an array of booleans in rank order."""
    rel = F.col(relevant) if isinstance(relevant, str) else relevant
    first = F.slice(rel, 1, k) if k > 0 else F.array().cast("array<boolean>")
    found = F.array_position(rel, F.lit(True))
    ideal = _gain(F.slice(F.sort_array(rel, False), 1, k)) if k > 0 else F.lit(0.0)
    return {
        "precision": (_count(first) / k if k > 0 else F.lit(0.0)).cast("double"),
        "recall": F.least(_count(first) / F.greatest(_count(rel), F.lit(1)), F.lit(1.0)).cast("double"),
        "rr": F.when(found > 0, 1 / found).otherwise(0.0).cast("double"),
        "hit": (_count(first) > 0).cast("double"),
        "ndcg": F.coalesce(_gain(first) / F.nullif(ideal, F.lit(0.0)), F.lit(0.0)),
    }


def rerank_metrics(before: Column, after: Column) -> dict[str, Column]:
    """Metrics before and after; k is the length of the reranked list, rr before takes the whole pool."""
    k = F.size(after)
    cut = lambda rel: F.when(k > 0, F.slice(rel, 1, F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<boolean>"))
    rr = lambda rel: F.when(F.array_position(rel, F.lit(True)) > 0, 1 / F.array_position(rel, F.lit(True))).otherwise(0.0).cast("double")
    gain = lambda rel: F.coalesce(_gain(cut(rel)) / F.nullif(_gain(cut(F.sort_array(rel, False))), F.lit(0.0)), F.lit(0.0))
    share = lambda rel: F.coalesce(_count(cut(rel)) / F.nullif(k, F.lit(0)), F.lit(0.0))
    hit = lambda rel: (_count(cut(rel)) > 0).cast("double")
    out = {}
    for name, f in (("mrr", rr), ("ndcg", gain), ("precision", share), ("hit", hit)):
        out[f"{name}_before"], out[f"{name}_after"] = f(before), f(after)
    return out


def id_metrics(retrieved: Column, relevant: Column, k: int) -> dict[str, Column]:
    """Precision, recall, hit and reciprocal rank of retrieved ids against relevant ids."""
    first = F.slice(retrieved, 1, k)
    hits = F.size(F.filter(first, lambda x: F.array_contains(relevant, x)))
    places = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda p: p.isNotNull())
    return {
        "precision": F.when(F.size(retrieved) > 0, hits / k).otherwise(0.0).cast("double"),
        "recall": F.coalesce(hits / F.nullif(F.size(relevant), F.lit(0)), F.lit(0.0)),
        "hit": (hits > 0).cast("double"),
        "rr": F.when(F.size(places) > 0, 1 / F.try_element_at(places, F.lit(1))).otherwise(0.0).cast("double"),
    }


def with_labels(traces: DataFrame, samples: DataFrame) -> DataFrame:
    """Traces joined with ``gold`` and the normalised ``answers`` of their sample; unlabelled ones stay, with null answers."""
    gold = samples.select("sample_id", F.when(strip(F.col("gold_answer")) != "", F.col("gold_answer")).alias("gold"), F.filter(F.transform("all_answers", normalise), lambda a: F.coalesce(a != "", F.lit(False))).alias("answers"))
    return traces.join(gold, "sample_id", "left")


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """``keys``, ``n`` and for every name the value at its rank (from 0, an expression of ``n``) of the sorted values.

    Null and NaN are no values; groups without any are left out.  A group is
    never gathered: equal values are counted before the shuffle, counts per
    cell of a fixed grid tell in which cells the ranks fall, and only those
    cells' values are put in order.
    """
    cell = F.floor(F.signum("__v") * F.log1p(F.abs("__v")) * 256)
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)").withColumn("__cell", cell)
    rows = rows.groupBy(*keys, "__cell", "__v").agg(F.count("*").alias("c"))
    counts = rows.groupBy(*keys, "__cell").agg(F.sum("c").alias("m"))
    group = Window.partitionBy(*keys)
    counts = counts.select(*keys, "__cell", "m", (F.sum("m").over(group.orderBy("__cell")) - F.col("m")).alias("below"), F.sum("m").over(group).alias("n"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.floor(at).cast("long").alias("at")) for name, at in ranks.items()])
    chosen = counts.select("*", F.inline(wanted)).where((F.col("at") >= F.col("below")) & (F.col("at") < F.col("below") + F.col("m"))).drop("m")
    r, c = rows.alias("r"), chosen.alias("c")
    same = reduce(and_, (F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "__cell"]))
    upto = F.col("c.below") + F.sum("r.c").over(Window.partitionBy(*[F.col(f"r.{k}") for k in keys], F.col("c.name")).orderBy("r.__v"))
    inside = r.join(c, same).select(*[F.col(f"r.{k}").alias(k) for k in keys], "r.__v", "r.c", "c.n", "c.name", "c.at", upto.alias("upto"))
    found = inside.where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("c")))
    return found.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("name") == name, F.col("__v"))).alias(name) for name in ranks])


def p95(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, n, p95``: the value at ``min(int(n * 0.95), n - 1)`` of the sorted values, not interpolated."""
    return at_ranks(df, keys, value, {"p95": F.least(F.floor(F.col("n") * F.lit(0.95)), F.col("n") - 1)})


def describe_by(df: DataFrame, keys: list[str], value: str, digits: int | None = None) -> DataFrame:
    """``keys``, ``mean, min, max, p5, p95`` (linear) of every group, 0 where it has no values; null and NaN are none."""
    own = df.select(*keys, F.col(value).cast("double").alias("__x")).withColumn("__x", F.when(~F.isnan("__x"), F.col("__x")))
    place = lambda q: (F.col("n") - 1) * F.lit(q)
    ranked = at_ranks(own, keys, "__x", {"a5": F.floor(place(0.05)), "b5": F.ceil(place(0.05)), "a95": F.floor(place(0.95)), "b95": F.ceil(place(0.95))})
    part = lambda q: place(q) - F.floor(place(q))
    ranked = ranked.select(*keys, *[(F.col(f"a{p}") + (F.col(f"b{p}") - F.col(f"a{p}")) * part(q)).alias(f"p{p}") for p, q in (("5", 0.05), ("95", 0.95))])
    means = own.groupBy(*keys).agg(F.avg("__x").alias("mean"), F.min("__x").alias("min"), F.max("__x").alias("max"))
    m, r = means.alias("m"), ranked.alias("r")
    both = m.join(r, reduce(and_, (F.col(f"m.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys)), "left")
    rounded = lambda c: F.coalesce(F.round(c, digits) if digits is not None else F.col(c), F.lit(0.0)).alias(c.split(".")[1])
    return both.select(*[F.col(f"m.{k}").alias(k) for k in keys], *map(rounded, ("m.mean", "m.min", "m.max", "r.p5", "r.p95")))


def compare(reports: DataFrame, name: str, metrics: list[str], pipelines: list[str]) -> DataFrame:
    """Metrics down, pipelines across."""
    long = reports.unpivot([name], metrics, "metric", "value")
    return long.groupBy("metric").pivot(name, pipelines).agg(F.first("value"))


def tokens_per_second(tokens: Column | str, nanoseconds: Column | str) -> Column:
    t, ns = (F.col(x) if isinstance(x, str) else x for x in (tokens, nanoseconds))
    return F.when((t > 0) & (ns > 0), t / (ns / 1e9))


def bertscore(prediction: Column | str, gold: Column | str) -> Column:
    """F of greedy matching: each token vector takes its greatest cosine on the other side (unit vectors in, 0 if a side is empty)."""
    from passageworks.functions.vectors import dot

    best = lambda xs, ys: F.aggregate(F.transform(xs, lambda x: F.array_max(F.transform(ys, lambda y: dot(x, y)))), F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(xs), F.lit(0))
    p, r = best(prediction, gold), best(gold, prediction)
    return F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))


def bertscore_texts(df: DataFrame, keys: list[str], prediction: str, gold: str, embedder: Embedder) -> DataFrame:
    """``keys`` and ``bertscore``: the same greedy matching over the vectors that ``embedder`` gives the words of two texts; 0 if a side has none."""
    n = len(keys)

    def unit(text: str | None) -> np.ndarray:
        vectors = [v for v in embedder.embed((text or "").split()) if v is not None]
        x = np.array(vectors, float)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if len(x) else x

    def f(a: str | None, b: str | None) -> float:
        x, y = unit(a), unit(b)
        if not len(x) or not len(y):
            return 0.0
        s = x @ y.T
        p, r = s.max(axis=1).mean(), s.max(axis=0).mean()
        return float(2 * p * r / (p + r)) if p + r else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [f(a, b) for a, b in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(scores, pa.float64())], [*keys, "bertscore"])

    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("bertscore", T.DoubleType())])
    return df.select(*keys, F.col(prediction).alias("__p"), F.col(gold).alias("__g")).mapInArrow(run, schema)

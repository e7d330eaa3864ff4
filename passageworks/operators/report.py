"""The report of an evaluation run: every stage's latency and quality, one nested row per pipeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passageworks.functions.text import exact_match, rouge_l_scores
from passageworks.operators import evaluate as E
from passageworks.operators.embed import Embedder, HashEmbedder

STAGES = ("embed", "retrieve", "rerank", "generate")
RETRIEVAL = ("precision", "recall", "rr", "hit", "ndcg")
RERANK = tuple(f"{n}_{w}" for n in ("mrr", "ndcg", "precision", "hit") for w in ("before", "after"))
TOKENS = ("prompt_tokens", "completion_tokens", "tokens_per_sec", "ttft_ms")


def latency_columns() -> list[Column]:
    """Milliseconds of each stage; a missing stage, null or NaN is 0."""
    return [F.coalesce(F.nanvl(F.try_element_at("latency_ms", F.lit(s)), F.lit(0.0)), F.lit(0.0)).alias(s) for s in STAGES]


def evaluate(traces: DataFrame, k: int = 10, dataset: str = "", embedder: Embedder | None = None, digits: int = 6) -> DataFrame:
    """One row per ``pipeline``: counts, clock, configuration and ``stages``, a struct per stage.

    ``traces`` are labelled (:func:`evaluate.with_labels`), one row a question;
    token columns (``TOKENS``) that are missing count as null, and means are
    over the rows that have the figure.  Retrieval and reranking are measured
    on rows with answers, generation on rows with a gold answer.  Every part is
    aggregated by itself to one row per pipeline, and the parts are joined.
    """
    rows = traces
    for c in TOKENS:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("double"))
    mean = lambda c, name: F.round(F.avg(c), digits).alias(name)
    key = F.col("pipeline")

    latencies = rows.select("pipeline", *latency_columns())
    speed = latencies.groupBy("pipeline").agg(
        *[mean(s, f"{s}_mean") for s in STAGES],
        *[F.round(F.coalesce(F.count("*") / F.nullif(F.sum(s) / 1000, F.lit(0.0)), F.lit(0.0)), digits).alias(f"{s}_qps") for s in STAGES],
    )
    slow = E.p95(latencies.unpivot(["pipeline"], list(STAGES), "stage", "ms"), ["pipeline", "stage"], "ms")
    slow = slow.groupBy("pipeline").agg(*[F.max(F.when(F.col("stage") == s, F.col("p95"))).alias(f"{s}_p95") for s in STAGES])

    clock = lambda f, name, bound: f(F.try_element_at("wall_time", F.lit(name))).cast("string").alias(bound)
    counts = rows.groupBy("pipeline").agg(
        F.count("*").alias("n_samples"), F.count("gold").alias("n_labelled"), clock(F.min, "pipeline_start", "pipeline_start"), clock(F.max, "pipeline_end", "pipeline_end"),
        F.max(F.size("retrieved")).alias("retriever_top_k"), F.max(F.size("reranked")).alias("reranker_top_k"),
        mean(F.when(F.col("gold").isNotNull(), exact_match("answer", "gold")), "exact_match"), *[mean(c, f"avg_{c}") for c in TOKENS],
    )

    texts = lambda hits: E.relevance(F.coalesce(F.col(hits)["text"], F.array().cast("array<string>")), "answers")
    relevant = rows.where(F.size("answers") > 0).select("pipeline", texts("retrieved").alias("b"), texts("reranked").alias("a"))
    found, moved = E.retrieval_metrics("b", k), E.rerank_metrics(F.col("b"), F.col("a"))
    quality = relevant.groupBy("pipeline").agg(*[mean(found[n], n) for n in RETRIEVAL], *[mean(moved[n], n) for n in RERANK])

    labelled = rows.where("gold IS NOT NULL")
    rouge = rouge_l_scores(labelled, ["pipeline"], "answer", "gold").groupBy("pipeline").agg(mean("rouge_l", "rouge_l"))
    bert = E.bertscore_texts(labelled, ["pipeline"], "answer", "gold", embedder or HashEmbedder()).groupBy("pipeline").agg(mean("bertscore", "bertscore_f1"))

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        other = right.withColumnRenamed("pipeline", "__p")  # one row per pipeline; its name may be null
        return left.join(other, left["pipeline"].eqNullSafe(other["__p"]), "left").drop("__p")

    one = reduce(joined, [speed, slow, quality, rouge, bert], counts)
    timing = lambda s: [F.col(f"{s}_mean").alias("avg_latency_ms"), F.col(f"{s}_p95").alias("p95_latency_ms"), F.col(f"{s}_qps").alias("qps")]
    delta = lambda n: F.round(F.col(f"{n}_after") - F.col(f"{n}_before"), digits).alias(f"{n}_delta")
    seconds = (F.unix_micros(F.col("pipeline_end").cast("timestamp")) - F.unix_micros(F.col("pipeline_start").cast("timestamp"))) / 1e6
    iso = lambda c: F.translate(c, " ", "T").alias(c)
    return one.select(
        key, F.lit(dataset).alias("dataset"), "n_samples", "n_labelled", iso("pipeline_start"), iso("pipeline_end"), seconds.alias("total_elapsed_s"),
        F.struct("retriever_top_k", "reranker_top_k", F.lit(k).alias("eval_k")).alias("config"),
        F.struct(
            F.struct(*timing("embed")).alias("embedding"),
            F.struct(*[F.col(n).alias("mrr" if n == "rr" else n) for n in RETRIEVAL], *timing("retrieve")).alias("retrieval"),
            F.struct(*RERANK, *map(delta, ("mrr", "ndcg", "precision")), *timing("rerank")).alias("reranking"),
            F.struct("exact_match", "rouge_l", "bertscore_f1", *[f"avg_{c}" for c in TOKENS], *timing("generate")).alias("generation"),
        ).alias("stages"),
    )


def summary(report: DataFrame) -> DataFrame:
    """``pipeline, line``: every figure of a report as a line of text, stage by stage."""
    figures = [(s.name, f.name) for s in report.schema["stages"].dataType for f in s.dataType]
    lines = [F.format_string(f"%-10s %-22s %s", F.lit(s), F.lit(f), F.coalesce(F.col("stages")[s][f].cast("string"), F.lit("-"))) for s, f in figures]
    head = F.format_string("%s: %d samples, %d labelled", F.coalesce("pipeline", F.lit("-")), "n_samples", "n_labelled")
    return report.select("pipeline", F.posexplode(F.array(head, *lines)).alias("place", "line")).orderBy("pipeline", "place").select("pipeline", "line")

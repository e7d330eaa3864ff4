"""The whole way from questions to answers, for a table of questions at once."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passageworks.functions.text import prompt
from passageworks.functions.vectors import invalid
from passageworks.operators import rerank, retrieval
from passageworks.operators.embed import HashEmbedder, embed_table
from passageworks.operators.generate import extract_answer
from passageworks.session import cut_lineage


def hash_vectors(df: DataFrame, key: str, text: str, dimensions: int = 64) -> DataFrame:
    """``key, embedding`` of every row with words, by signed feature hashing; others have no vector, as if an embedder skipped them."""
    return embed_table(df, key, text, HashEmbedder(dimensions)).where("embedding IS NOT NULL")


@dataclass
class QuestionPipeline:
    """Embed, retrieve, rerank, assemble, answer; each part may be replaced.

    ``store`` has ``vec_id long, chunk_id, text, embedding``; ``embed`` makes
    ``key, embedding`` of a table of texts; ``score`` rates (question, text)
    pairs, None keeps the order of retrieval; ``answer`` makes an answer from
    the reranked texts.
    """

    store: DataFrame
    embed: Callable[[DataFrame, str, str], DataFrame] = hash_vectors
    score: Callable[[Column, Column], Column] | None = rerank.overlap_score
    answer: Callable[[Column], Column] = extract_answer
    dimensions: int = 64
    metric: str = "cosine"
    k: int = 30
    rerank_k: int = 10

    def describe(self) -> dict[str, object]:
        return {"embed": self.embed.__name__, "score": self.score.__name__ if self.score else "passthrough", "metric": self.metric, "k": self.k, "rerank_k": self.rerank_k}

    def run(self, questions: DataFrame, key: str = "sample_id", query: str = "query") -> DataFrame:
        """One row per question: ``key, query, retrieved, reranked, prompt, answer``; a question without a vector keeps empty lists."""
        own = questions.select(F.col(key).cast("long").alias("qid"), F.col(query).alias("query"))
        return self._answers(own, self._reranked(own, self._retrieved(own, self._embedded(own))), key)

    def run_traced(self, questions: DataFrame, key: str = "sample_id", query: str = "query") -> DataFrame:
        """As :meth:`run`, with ``latency_ms`` and ``wall_time`` of each stage and ``meta`` of what it gave.

        Questions go through a stage together, so that each stage is run by
        itself, its result written to the shared folder, and its time divided
        by the questions; the jobs run while this is called.
        """
        own = cut_lineage(questions.select(F.col(key).cast("long").alias("qid"), F.col(query).alias("query")))
        n, clock = max(1, own.count()), {"pipeline_start": datetime.now(UTC)}
        took: dict[str, float] = {}

        def timed(stage: str, df: DataFrame) -> DataFrame:
            began = time.time()
            out = cut_lineage(df)
            took[stage] = (time.time() - began) * 1000 / n
            return out

        asked = timed("embed", self._embedded(own))
        hits = timed("retrieve", self._retrieved(own, asked))
        best = timed("rerank", self._reranked(own, hits))
        clock["generate_start"] = datetime.now(UTC)
        out = timed("generate", self._answers(own, best, key))
        clock["pipeline_end"] = datetime.now(UTC)
        latency = F.map_from_arrays(F.array(*map(F.lit, took)), F.array(*[F.lit(x) for x in took.values()]))
        wall = F.map_from_arrays(F.array(*map(F.lit, clock)), F.array(*[F.lit(x.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz") for x in clock.values()]))
        meta = F.struct(
            F.lit(self.dimensions).alias("embedding_dim"), F.lit(self.metric).alias("metric"), F.lit(self.k).alias("requested_k"), F.size("retrieved").alias("returned_k"),
            F.lit(self.describe()["score"]).alias("reranker"), F.lit(self.rerank_k).alias("rerank_k"), F.size("reranked").alias("context_chunks"), F.length("answer").alias("answer_chars"),
        )
        return out.select("*", latency.alias("latency_ms"), wall.alias("wall_time"), meta.alias("meta"))

    def _embedded(self, own: DataFrame) -> DataFrame:
        return self.embed(own, "qid", "query").withColumnRenamed("qid", "vec_id")

    def _retrieved(self, own: DataFrame, asked: DataFrame) -> DataFrame:
        store = self.store.where(~invalid("embedding", self.dimensions))
        hits = retrieval.dense_topk(asked, store.select("vec_id", "embedding"), self.k, self.metric, exclude_self=False)
        # texts are joined after the cut to k
        return retrieval.lookup(hits, store.select("vec_id", "chunk_id", "text")).join(own, "qid")

    def _reranked(self, own: DataFrame, hits: DataFrame) -> DataFrame:
        score = self.score(F.col("query"), F.col("text")) if self.score else -F.col("rk").cast("double")
        return rerank.rerank(hits, score, self.k, "qid", "rk")

    def _answers(self, own: DataFrame, best: DataFrame, key: str) -> DataFrame:
        item = lambda rank, score: F.struct(F.col(rank).alias("rank"), "chunk_id", "text", F.col(score).alias("score"))
        lists = best.groupBy("qid").agg(
            F.array_sort(F.collect_list(item("rk", "score"))).alias("retrieved"),  # k per question
            F.array_sort(F.collect_list(F.when(F.col("new_rank") <= self.rerank_k, item("new_rank", "rerank_score")))).alias("reranked"),
        )
        out = own.join(lists, "qid", "left")
        for name in ("retrieved", "reranked"):
            out = out.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
        texts = F.col("reranked")["text"]
        return out.select(F.col("qid").alias(key), "query", "retrieved", "reranked", prompt("query", texts).alias("prompt"), self.answer(texts).alias("answer"))

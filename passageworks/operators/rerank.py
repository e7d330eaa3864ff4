"""Rerankers over hits: passthrough, and any scorer of (question, text) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passageworks.functions.text import words


def pairs(traces: DataFrame, key: str = "trace_id", query: str = "query", hits: str = "retrieved") -> DataFrame:
    """One row per question and hit: ``key, query, rank, chunk_id, text, score``; no hits, no rows."""
    return traces.select(key, query, F.inline(hits))


def passthrough(hits: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` hits as retrieved."""
    return hits.where(F.col(rank) <= k)


def overlap_score(query: Column | str, text: Column | str) -> Column:
    """Jaccard similarity of the words of question and text: a lexical stand-in for a cross-encoder."""
    q, t = F.array_distinct(words(query)), F.array_distinct(words(text))
    return F.coalesce(F.size(F.array_intersect(q, t)) / F.nullif(F.size(F.array_union(q, t)), F.lit(0)), F.lit(0.0))


def rerank(hits: DataFrame, score: Column, k: int, key: str = "trace_id", rank: str = "rank") -> DataFrame:
    """``hits`` with ``rerank_score`` and ``new_rank``, the ``k`` best per question; equal scores keep their order.

    The retrieval score stays beside the new one.  A question's hits are
    bounded by what was retrieved for it.
    """
    scored = hits.withColumn("rerank_score", score)
    order = Window.partitionBy(key).orderBy(F.col("rerank_score").desc(), rank)
    return scored.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k)

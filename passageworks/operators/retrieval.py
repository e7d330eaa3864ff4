"""Exact dense retrieval for a set of questions, and the lookup of what was found."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passageworks.session import by_blocks

#: Most query vectors of one broadcast; more are searched block by block, each against the whole corpus.
QUERY_BLOCK = 8192
METRICS = ("cosine", "dot", "l2")


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def similarity(queries: np.ndarray, corpus: np.ndarray, metric: str) -> np.ndarray:
    """Greater is nearer: cosine (0 for zero vectors), product, or minus the squared distance."""
    product = queries @ corpus.T
    if metric == "dot":
        return product
    a, b = (np.einsum("ij,ij->i", x, x) for x in (queries, corpus))
    if metric == "l2":
        return -np.maximum(a[:, None] + b[None, :] - 2 * product, 0.0)
    length = np.sqrt(a)[:, None] * np.sqrt(b)[None, :]
    return np.divide(product, length, out=np.zeros_like(product), where=length > 0)


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", exclude_self: bool = True, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``qid, did, rk, score`` of the ``k`` nearest of ``corpus`` for every query vector, best first.

    Scores are those of ``vectors.score``, rounded to 9 places; ties go by id.
    Both sides hold vectors of one length without nulls (filter with
    ``vectors.invalid``).  Queries travel in blocks of a fixed size to every
    partition of the corpus, where block products run in numpy; a partition
    sends only its ``k`` best per query to the final ranking.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")

    def search(ids: np.ndarray, q: np.ndarray, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best = Best(ids, k, exclude_self)
            for batch in batches:
                if batch.num_rows and len(ids):
                    did, x = batch.column(0).to_numpy(), matrix(batch.column(1))
                    for at in range(0, len(did), 2048):
                        best.add(similarity(q, x[at : at + 2048], metric), did[at : at + 2048])
            yield from best.batches()

        return corpus.select(F.col(key).cast("long").alias("id"), vector).mapInArrow(run, HITS)

    found = in_query_blocks(queries, search, key, vector, query_block)
    return rank_hits(found.select("qid", "did", F.round(scored(F.col("similarity"), metric), 9).alias("score")), k)


HITS = "qid long, did long, similarity double"


def scored(nearness: Column, metric: str) -> Column:
    """A hit's score from what ``similarity`` gives."""
    return {"cosine": (nearness + 1) / 2, "dot": nearness, "l2": 1 / (1 - nearness)}[metric]


def in_query_blocks(queries: DataFrame, search: Callable[[np.ndarray, np.ndarray, Broadcast], DataFrame], key: str, vector: str, block: int) -> DataFrame:
    """Hits of all queries, whose ids and vectors are broadcast in blocks of about ``block``."""
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // block))

    def one(i: int) -> tuple[DataFrame, Broadcast]:
        own = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == i) if blocks > 1 else queries
        table = own.select(F.col(key).cast("long").alias("id"), vector).toArrow().combine_chunks()
        ids = table["id"].to_numpy()
        q = matrix(table[vector].combine_chunks()) if len(ids) else np.zeros((0, 1))
        shared = spark.sparkContext.broadcast((ids, q))
        return search(ids, q, shared), shared

    return by_blocks(spark, "hits", blocks, one)


class Best:
    """The ``k`` nearest of every query among all that was added: by similarity to 12 places, then by id."""

    def __init__(self, ids: np.ndarray, k: int, exclude_self: bool):
        self.ids, self.k, self.exclude_self = ids, k, exclude_self
        self.s, self.d = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)

    def add(self, s: np.ndarray, did: np.ndarray, of: np.ndarray | slice = slice(None)) -> None:
        """Adds the similarities ``s`` of ``did`` to the queries at ``of``."""
        if self.exclude_self:
            s[self.ids[of][:, None] == did[None, :]] = -np.inf
        s = np.concatenate([self.s[of], s], axis=1)
        d = np.concatenate([self.d[of], np.broadcast_to(did, (len(s), len(did)))], axis=1)
        order = np.lexsort((d, -np.round(s, 12)), axis=1)[:, : self.k] if s.shape[1] <= 4 * self.k else _top(s, d, self.k)
        s, d = np.take_along_axis(s, order, 1), np.take_along_axis(d, order, 1)
        if self.s.shape[1] < s.shape[1]:
            more = s.shape[1] - self.s.shape[1]
            self.s = np.pad(self.s, ((0, 0), (0, more)), constant_values=-np.inf)
            self.d = np.pad(self.d, ((0, 0), (0, more)))
        self.s[of], self.d[of] = s, d

    def batches(self) -> Iterator[pa.RecordBatch]:
        at, place = np.nonzero(self.s > -np.inf)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[at]), pa.array(self.d[at, place]), pa.array(self.s[at, place])], ["qid", "did", "similarity"])


def _top(s: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` greatest of each row, ties at the border by id."""
    # only what is as near as the k-th by plain order can be among them
    near = np.round(s, 12)
    border = -np.partition(-near, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(s), k), np.int64)
    for i, least in enumerate(border):
        own = np.flatnonzero(near[i] >= least)
        out[i] = own[np.lexsort((d[i][own], -near[i][own]))[:k]]
    return out


def rank_hits(hits: DataFrame, k: int, query: str = "qid", hit: str = "did", score: str = "score") -> DataFrame:
    """``rk`` from 1 by score, then id; the ``k`` best per query (cut before the shuffle)."""
    order = Window.partitionBy(query).orderBy(F.col(score).desc(), hit)
    return hits.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k).select(query, hit, "rk", score)


def lookup(hits: DataFrame, store: DataFrame, key: str = "vec_id", hit: str = "did") -> DataFrame:
    """Hits with the columns of what was hit, joined after the cut to ``k``."""
    return hits.join(store, hits[hit] == store[key]).drop(store[key])

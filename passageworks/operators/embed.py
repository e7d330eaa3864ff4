"""Embedders: texts to vectors in batches, rows that fail skipped, and a stand-in without a model."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts encoded at once.
BATCH = 256
_RUNS = re.compile("[a-z0-9]+")


@lru_cache(maxsize=200_000)
def _hashed(word: str) -> tuple[int, int]:
    """A word's number and sign, from the first and second eight digits of its md5."""
    digits = md5(word.encode()).hexdigest()
    return int(digits[:8], 16), 1 if int(digits[8:16], 16) % 2 == 0 else -1


def hashed_words(text: str | None, dimensions: int) -> dict[int, int]:
    """Bucket to sum of signs over a text's lower-case runs of a-z and 0-9."""
    out: Counter = Counter()
    for word, n in Counter(_RUNS.findall((text or "").lower())).items():
        number, sign = _hashed(word)
        out[number % dimensions] += sign * n
    return out


class Embedder:
    """What an embedder must offer: ``name``, ``dimension`` and ``encode``; the rest follows from these.

    ``encode`` takes texts and gives one vector each; it may raise ``ValueError``.
    """

    name = "embedder"
    _dimension: int | None = None

    def encode(self, texts: list[str]) -> np.ndarray:
        raise NotImplementedError

    @property
    def dimension(self) -> int:
        """As set, else found by encoding one word."""
        if self._dimension is None:
            self._dimension = int(np.asarray(self.encode(["dimension"])).shape[1])
        return self._dimension

    def embed(self, texts: list[str | None]) -> list[list[float] | None]:
        """A vector for every text, None for those skipped: null texts, and those that fail when tried one by one after their batch failed."""
        out: list[list[float] | None] = [None] * len(texts)
        known = [i for i, x in enumerate(texts) if x is not None]
        for at in range(0, len(known), BATCH):
            own = known[at : at + BATCH]
            try:
                found = self._checked([texts[i] for i in own])
            except ValueError:
                found = [self._alone(texts[i]) for i in own]
            for i, v in zip(own, found):
                out[i] = v
        return out

    def embed_one(self, text: str) -> list[float]:
        """The vector of one text; ``ValueError`` if it is skipped."""
        (vector,) = self.embed([text])
        if vector is None:
            raise ValueError("the text could not be embedded")
        return vector

    def _checked(self, texts: list[str]) -> list[list[float] | None]:
        vectors = np.asarray(self.encode(texts), dtype=np.float64)
        if vectors.shape != (len(texts), self.dimension):
            raise ValueError(f"{vectors.shape} are not {len(texts)} vectors of {self.dimension}")
        fine = np.isfinite(vectors).all(axis=1)
        return [v.tolist() if ok else None for v, ok in zip(vectors, fine)]

    def _alone(self, text: str) -> list[float] | None:
        try:
            return self._checked([text])[0]
        except ValueError:
            return None


class HashEmbedder(Embedder):
    """Signed feature hashing of words; texts without words are skipped, as a model would skip what it cannot encode."""

    def __init__(self, dimensions: int = 64):
        self._dimension, self.name = dimensions, f"hash-{dimensions}"

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self._dimension))
        for i, text in enumerate(texts):
            buckets = hashed_words(text, self._dimension)
            if not buckets:
                raise ValueError("a text without words")
            out[i, list(buckets)] = list(buckets.values())
        return out


def embed_table(df: DataFrame, key: str, text: str, embedder: Embedder) -> DataFrame:
    """``key`` and ``embedding`` of every row, null where the embedder skips it; one Arrow pass, no shuffle."""
    schema = T.StructType([df.schema[key], T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(embedder.embed(batch.column(1).to_pylist()), pa.list_(pa.float32()))], schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def hash_embed(df: DataFrame, key: str, text: str, dimensions: int = 64) -> DataFrame:
    """``key``, ``bucket`` and ``v``: the hashed words of a text by bucket; buckets of value 0 only where words cancel.

    A text is one row, so that its buckets are summed within it and nothing is
    shuffled; a repeated key gives its buckets for every row.
    """
    schema = T.StructType([df.schema[key], T.StructField("bucket", T.LongType()), T.StructField("v", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashed_words(x, dimensions) for x in batch.column(1).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            columns = [pa.array([x for f in found for x in part(f)], pa.int64()) for part in (dict.keys, dict.values)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], schema.names)

    return df.select(key, text).mapInArrow(run, schema)

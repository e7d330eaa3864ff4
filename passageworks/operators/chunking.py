"""Chunkers: fixed windows of characters, and passages passed through."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passageworks.functions.text import strip


def chunk_fixed(df: DataFrame, key: str, text: str, size: int = 512, overlap: int = 0) -> DataFrame:
    """``key, chunk_idx, chunk_id, chunk_text`` of every window of ``size`` code points, ``overlap`` shared.

    The last window ends with the text; windows are stripped, empty ones are
    dropped after counting, so ``chunk_idx`` may have gaps.  Null and empty
    texts give nothing.  ``size > overlap >= 0`` is required.  No shuffle.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("need size > overlap >= 0")
    step = size - overlap
    schema = T.StructType([df.schema[key], T.StructField("chunk_idx", T.IntegerType()), T.StructField("chunk_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, places, pieces = [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                last = max(-(-(len(value) - size) // step), 0) if value else -1
                for place in range(last + 1):
                    piece = value[place * step : place * step + size].strip()
                    if piece:
                        at.append(i)
                        places.append(place)
                        pieces.append(piece)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(places, pa.int32()), pa.array(pieces, pa.string())], schema.names)

    # a text is sliced once, however long it is
    out = df.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)
    return out.select(key, "chunk_idx", F.concat(F.lit("doc"), F.col(key), F.lit("_chunk"), F.col("chunk_idx")).alias("chunk_id"), "chunk_text")


def chunk_prechunked(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, chunk_id, chunk_text``: each passage as one chunk, stripped; null and blank ones are dropped."""
    out = df.select(key, strip(text).alias("chunk_text")).where(F.col("chunk_text") != "")
    return out.select(key, F.concat(F.lit("passage"), F.col(key)).alias("chunk_id"), "chunk_text")

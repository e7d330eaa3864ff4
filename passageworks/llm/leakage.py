"""Held-out evaluation passages inside a training corpus.

Method: the normalised n-grams of all test items form a hash set that is sent
to the executors; the word windows of every training text are looked up in it,
hits are verified word by word, and spans or whole documents are removed.

A window of ``n`` words covers exactly one word whose position is a multiple
of ``n``; only there is the text compared with the words of the test items,
and only where a whole run of ``n`` known words stands are windows built.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from passageworks.session import by_blocks

#: Consecutive words that make a leak.
WINDOW_WORDS = 12
#: Words of test items per broadcast; larger test sets are searched block by block, each against the whole corpus.
BLOCK_WORDS = 1_000_000
_WORDS = re.compile(r"[^\W_]+").finditer


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits in any script, each in lower case."""
    low = text.lower()
    if len(low) == len(text) and "Σ" not in text:  # else a letter's lower case depends on its neighbours, or is two characters
        return re.findall(r"[^\W_]+", low)
    return [w.lower() for w in re.findall(r"[^\W_]+", text)]


class LeakIndex:
    """Windows of the test items, by their words."""

    def __init__(self, items: Iterable[tuple[int, str | None]], n: int):
        self.n = n
        self.windows: dict[tuple[str, ...], set[int]] = defaultdict(set)
        for item, text in items:
            own = words(text or "")
            for i in range(len(own) - n + 1):
                self.windows[tuple(own[i : i + n])].add(item)
        self.known = {w for window in self.windows for w in window}

    def find(self, text: str) -> dict[int, list[tuple[int, int, int]]]:
        """Start, end and number of words of each stretch of ``text`` that a leaked item covers, in order and merged where they meet."""
        if not self.windows:
            return {}
        own, n, known = words(text), self.n, self.known
        count, done, hits = len(own), 0, defaultdict(list)
        for anchor in range(n - 1, count, n):
            if anchor < done or own[anchor] not in known:
                continue
            start = anchor
            while start > done and own[start - 1] in known:
                start -= 1
            end = anchor + 1
            while end < count and own[end] in known:
                end += 1
            for i in range(start, end - n + 1):
                for item in self.windows.get(tuple(own[i : i + n]), ()):
                    runs = hits[item]
                    if runs and runs[-1][1] >= i:
                        runs[-1][1] = i + n
                    else:
                        runs.append([i, i + n])
            done = end
        if not hits:
            return {}
        places = [m.span() for m in _WORDS(text)]
        return {item: [(places[a][0], places[b - 1][1], b - a) for a, b in runs] for item, runs in hits.items()}


def _blocks(items: DataFrame, item_key: str, item_text: str, limit: int) -> list[DataFrame]:
    """Items in blocks of about ``limit`` words at most, by their hash; one block for an ordinary test set."""
    rows = items.select(F.col(item_key).alias("__item"), F.col(item_text).cast("string").alias("__text")).where(F.col("__text").isNotNull())
    total = rows.agg(F.sum(F.length("__text"))).first()[0] or 0
    count = max(1, -(-int(total) // (6 * limit)))
    return [rows.where(F.pmod(F.xxhash64("__item"), F.lit(count)) == i) for i in range(count)] if count > 1 else [rows]


@lru_cache(maxsize=2)
def _index(name: str, shared: Broadcast, n: int) -> LeakIndex:
    """The index of a broadcast block, built once per worker process."""
    return LeakIndex(shared.value, n)


class _Shared:
    """A broadcast that is equal to itself alone, so that a cache may be keyed by it."""

    def __init__(self, broadcast: Broadcast, n: int):
        self.name, self.broadcast, self.n = uuid.uuid4().hex, broadcast, n

    def index(self) -> LeakIndex:
        return _index(self.name, _Keyless(self.broadcast), self.n)


class _Keyless:
    """Takes no part in the key of a cache."""

    def __init__(self, broadcast: Broadcast):
        self.broadcast = broadcast

    @property
    def value(self):
        return self.broadcast.value

    def __hash__(self) -> int:
        return 0

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Keyless)


def _shared(docs: DataFrame, block: DataFrame, n: int) -> _Shared:
    pairs = [(r[0], r[1]) for r in block.collect()]  # bounded by the words of a block
    return _Shared(docs.sparkSession.sparkContext.broadcast(pairs), n)


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", n: int = WINDOW_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each row of ``docs`` and test item that share at least ``n`` consecutive words:
    the two keys, ``words`` (the length of the longest stretch shared) and ``spans`` (start and
    end, in code points, of what leaked).

    Null, empty and short texts share nothing; repeated document rows each
    give their rows, repeated item rows give one; a null item key is kept as
    null; extra columns are ignored.  If both keys have the same name the
    item's comes out as ``item_<name>``.

    The corpus is scanned once per block of items and never shuffled.
    """
    out_item = item_key if item_key != key else f"item_{item_key}"
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([docs.schema[key], T.StructField(out_item, items.schema[item_key].dataType), T.StructField("words", T.IntegerType()), T.StructField("spans", T.ArrayType(span))])
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("__text")).where(F.length("__text") >= 2 * n - 1)
    item_kind = to_arrow_type(items.schema[item_key].dataType)
    blocks = _blocks(items, item_key, item_text, block_words)

    def one(i: int) -> tuple[DataFrame, Broadcast]:
        shared = _shared(docs, blocks[i], n)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.index()
            for batch in batches:
                at, leaked, longest, spans = [], [], [], []
                for i, value in enumerate(batch.column(1).to_pylist()):
                    for item, places in index.find(value).items():
                        at.append(i)
                        leaked.append(item)
                        longest.append(max(count for *_, count in places))
                        spans.append([{"start": a, "end": b} for a, b, _ in places])
                if at:
                    kind = pa.struct([("start", pa.int32()), ("end", pa.int32())])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(leaked, item_kind), pa.array(longest, pa.int32()), pa.array(spans, pa.list_(kind))], [key, out_item, "words", "spans"])

        return rows.mapInArrow(run, schema), shared.broadcast

    return by_blocks(docs.sparkSession, "leaks", len(blocks), one)


def remove_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", whole_documents: bool = False, item_key: str = "item_id", item_text: str = "text", n: int = WINDOW_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without what leaked: leaked spans become one space each, or leaked documents go.

    Every row is cut by its own spans in the pass that finds them, so that
    nothing is joined or shuffled and rows with a repeated or null key are kept
    apart; rows without a leak pass unchanged.  More blocks of items add a pass
    each, in which their spans are noted; the last one cuts.
    """
    at = docs.columns.index(text)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    noted = T.StructField("__spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
    out = docs.withColumn("__spans", F.array().cast(noted.dataType))
    for block in _blocks(items, item_key, item_text, block_words):
        shared = _shared(docs, block, n)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.index()
            for batch in batches:
                own = [index.find(x) if x else {} for x in batch.column(at).to_pylist()]
                if not any(own):
                    yield batch
                    continue
                spans = [old + [{"start": a, "end": b} for places in found.values() for a, b, _ in places] for old, found in zip(batch.column(batch.num_columns - 1).to_pylist(), own)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, kind)], batch.schema.names)

        out = out.mapInArrow(run, T.StructType([*docs.schema.fields, noted]))
    if whole_documents:
        return out.where(F.size("__spans") == 0).select(*docs.columns)

    @F.pandas_udf(T.StringType())
    def without(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([_cut(*x) for x in zip(texts, starts, ends)])

    # the expression of a row without spans is its text; the cut of the others is found once
    spans = F.sort_array("__spans")
    cut = without(F.when(F.size("__spans") > 0, F.col(text)), F.when(F.size("__spans") > 0, spans["start"]), F.when(F.size("__spans") > 0, spans["end"]))
    return out.withColumn("__cut", cut).withColumn(text, F.when(F.size("__spans") > 0, F.col("__cut")).otherwise(F.col(text))).select(*docs.columns)


def _cut(value: str | None, starts: Iterable[int] | None, ends: Iterable[int] | None) -> str | None:
    if value is None or starts is None:
        return None
    out, at = [], 0
    for start, end in zip(starts, ends):
        if start >= at:
            out.append(value[at:start])
        at = max(at, end)
    return " ".join([*out, value[at:]])

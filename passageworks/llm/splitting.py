"""Splitting of oversized items at natural boundaries, with an exact overlap.

Method: a recursive hierarchy of separators.  A text is divided at section
breaks; parts still too large are divided at paragraph breaks, then lines,
sentences, words and at last between characters.  The resulting parts, each
short enough to follow an overlap, are packed greedily up to the limit; every
piece after the first begins with the last ``chunk_overlap`` characters of the
one before it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The hierarchy, from the coarsest level to words; a match ends a part, so separators stay with what they close.
LEVELS: tuple[tuple[str, re.Pattern[str]], ...] = (
    ("section", re.compile(r"(?:\r?\n[^\S\n]*){3,}|\f|\r?\n(?=#{1,6} )|\r?\n(?:[-*_=] ?){3,}\r?\n")),
    ("paragraph", re.compile(r"(?:\r\n|\n|\r)[^\S\r\n]*(?:\r\n|\n|\r)|\u2029")),
    ("line", re.compile(r"\r\n|\n|\r|\u2028|\x85")),
    ("sentence", re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』）”]*|[؟۔।॥]+\s*")),
    ("word", re.compile(r"\s+|(?<=[-–—/])(?=\w)")),
)
_JOINERS = {"\u200d", "\ufe0e", "\ufe0f"}
_SCHEMA = [("piece_idx", T.IntegerType()), ("n_pieces", T.IntegerType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("boundary", T.StringType()), ("piece", T.StringType()), ("status", T.StringType())]


def _inside_character(text: str, at: int) -> bool:
    """Whether a cut at ``at`` would part a character from its marks, joiners or other half."""
    after, before = text[at], text[at - 1]
    if after in _JOINERS or before == "\u200d" or unicodedata.combining(after) or unicodedata.category(after) in ("Mn", "Mc", "Me"):
        return True
    if before == "\r" and after == "\n" or 0x1F3FB <= ord(after) <= 0x1F3FF:
        return True
    if 0x1F1E6 <= ord(after) <= 0x1F1FF and 0x1F1E6 <= ord(before) <= 0x1F1FF:
        first = at - 1
        while first > 0 and 0x1F1E6 <= ord(text[first - 1]) <= 0x1F1FF:
            first -= 1
        return (at - first) % 2 == 1
    return False


def _characters(text: str, start: int, end: int, room: int) -> list[tuple[int, str]]:
    """Cuts every ``room`` characters, moved back to whole characters where that leaves a part."""
    cuts, at = [], start
    while end - at > room:
        cut = at + room
        while cut > at + 1 and _inside_character(text, cut):
            cut -= 1
        if cut == at + 1 and _inside_character(text, cut):
            cut = at + room  # one character with more marks than fit
        cuts.append((cut, "character"))
        at = cut
    return [*cuts, (end, "")]


def _parts(text: str, start: int, end: int, room: int, level: int) -> list[tuple[int, str]]:
    """Ends of the parts of ``text[start:end]``, each of at most ``room``, with the level of each cut."""
    if level == len(LEVELS):
        return _characters(text, start, end, room)
    name, separator = LEVELS[level]
    ends = sorted({m.end() for m in separator.finditer(text, start, end) if start < m.end() < end})
    out: list[tuple[int, str]] = []
    for a, b in pairwise([start, *ends, end]):
        if b - a > room:
            out += _parts(text, a, b, room, level + 1)
            out[-1] = (b, name)
        else:
            out.append((b, name))
    return out


def split_spans(text: str, size: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, level of the cut) of the pieces of ``text``; spans overlap by exactly ``overlap``.

    A text of at most ``size`` code points is one span; joining the spans
    without their overlaps gives the text again.  The exact overlap wins over
    whole characters: a piece ends between a letter and its mark only where no
    whole character fits, but begins ``overlap`` code points before that end,
    wherever this falls.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError(f"chunk_size {size} and chunk_overlap {overlap}: need size > overlap >= 0")
    if len(text) <= size:
        return [(0, len(text), "end")]
    spans: list[tuple[int, int, str]] = []
    start, end, last = 0, 0, ""
    for cut, level in _parts(text, 0, len(text), size - overlap, 0):
        if cut - start > size:
            spans.append((start, end, last))
            start = end - overlap
        end, last = cut, level
    return [*spans, (start, end, "end")]


def split_oversized(df: DataFrame, key: str | list[str] = "chunk_id", text: str = "text", size: Column | str = "chunk_size", overlap: Column | str = "chunk_overlap") -> DataFrame:
    """One row per piece of every row of ``df``: the key columns, then ``piece_idx`` (from 0), ``n_pieces``,
    ``start`` and ``end`` (code points), ``boundary`` (what ends the piece), ``piece`` and ``status``.

    ``status`` is ``whole`` (fits; one row, also for an empty text), ``split``,
    ``null_text`` or ``bad_config`` (null size or overlap, or not
    size > overlap >= 0); the last two give one row with a null piece.
    Repeated rows each give their pieces; null keys stay null; other columns
    are left out whatever their names.

    Only rows over their limit travel to Python; no shuffle.
    """
    keys = [key] if isinstance(key, str) else key
    column = lambda x: F.col(x) if isinstance(x, str) else x
    rows = df.select(*keys, F.col(text).cast("string").alias("__text"), column(size).cast("int").alias("__size"), column(overlap).cast("int").alias("__overlap"))
    good = F.coalesce((F.col("__overlap") >= 0) & (F.col("__size") > F.col("__overlap")), F.lit(False))
    length = F.length("__text")
    rows = rows.withColumn(
        "status",
        F.when(F.col("__text").isNull(), "null_text").when(~good, "bad_config").when(length <= F.col("__size"), "whole").otherwise("split"),
    )
    whole = F.col("status") == "whole"
    one = F.when(whole, F.lit(1))
    straight = rows.where(F.col("status") != "split").select(
        *keys,
        F.when(whole, F.lit(0)).alias("piece_idx"), one.alias("n_pieces"), F.when(whole, F.lit(0)).alias("start"), F.when(whole, length).alias("end"),
        F.when(whole, F.lit("end")).alias("boundary"), F.when(whole, F.col("__text")).alias("piece"), "status",
    )
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(n, t) for n, t in _SCHEMA])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rest: list[tuple] = []
            texts, sizes, overlaps = (batch.column(n + i).to_pylist() for i in range(3))
            for i, (value, limit, shared) in enumerate(zip(texts, sizes, overlaps)):
                spans = split_spans(value, limit, shared)
                at += [i] * len(spans)
                rest += [(k, len(spans), a, b, level, value[a:b], "split") for k, (a, b, level) in enumerate(spans)]
            columns = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(n)]
            kinds = [pa.int32()] * 4 + [pa.string()] * 3
            columns += [pa.array([r[i] for r in rest], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, [*keys, *(x for x, _ in _SCHEMA)])

    cut = rows.where(F.col("status") == "split").select(*keys, "__text", "__size", "__overlap").mapInArrow(run, schema)
    return straight.unionByName(cut)

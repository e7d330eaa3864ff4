"""Vector expressions over ``array<float>`` columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column | str) -> Column:
    """The vector over its norm; a zero vector stays as it is."""
    length = F.nullif(norm(a), F.lit(0.0))
    return F.transform(a, lambda x: F.coalesce(x.cast("double") / length, F.lit(0.0)))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 if either vector is zero."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def score(similarity: Column, metric: str) -> Column:
    """A hit's score: cosine mapped to [0, 1], the product itself, or 1 / (1 + squared distance)."""
    return {"cosine": (similarity + 1) / 2, "dot": similarity, "l2": 1 / (1 + similarity)}[metric]


def invalid(a: Column | str, dimensions: int) -> Column:
    """Whether a vector cannot be indexed: null, of another length, or with a null, NaN or infinite part."""
    v = _column(a)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return ~F.coalesce((F.size(v) == dimensions) & finite, F.lit(False))

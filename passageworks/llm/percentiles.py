"""Medians and other percentiles per group over very large numeric columns.

Method: exact bisection.  For every group and wanted rank an interval of values
is kept that surely holds the value of that rank.  Each pass counts the rows
below midpoints inside the open intervals (255 midpoints at once, so that few
passes are needed), keeps the part in which the rank falls, shrunk to the
smallest and largest value seen there, and ends when every interval is one
value.  The result is exact.

Counts below fixed midpoints add up, so results of days and partitions are
combined through ``summarise``: per group, the number, least and greatest value
in each cell of one fixed grid of midpoints.  Summaries are merged by adding
them; the same bisection over a summary gives percentiles whose relative error
is at most that of a cell (``2**-(bits+1)`` of the value).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passageworks.session import BROADCAST_ROWS, rewritten

#: Parts of a group whose intervals are joined, not broadcast.
HOT_PARTS = 32
#: Parts into which one pass divides an open interval.
FANOUT = 256
#: Cells of a summary per doubling of a value, as a power of two: values in a cell differ by less than one part in 64.
SUMMARY_BITS = 6


def _value(column: Column) -> Column:
    """The number, or null for null and NaN; negative zero is zero."""
    number = column.cast("double")
    return F.when(~F.isnan(number), number + F.lit(0.0))


def _part(v: Column, lo: Column, hi: Column, fanout: int) -> Column:
    """In which part of [lo, hi] ``v`` lies; never decreasing in ``v``, and lo and hi lie in different parts.

    Parts are equal in value where lo and hi are near each other and equal in
    the logarithm where they are not.  Around zero either sign has its own
    parts, and zero too, so that later passes see one sign only.
    """
    size = lambda x: F.log(F.nullif(F.abs(x), F.lit(0.0)))
    near = F.greatest(F.abs(lo), F.abs(hi)) <= F.least(F.abs(lo), F.abs(hi)) * 4
    linear = (v - lo) / F.nullif(hi - lo, F.lit(0.0))
    relative = (size(v) - size(lo)) / F.nullif(size(hi) - size(lo), F.lit(0.0))
    one_sign = F.floor(F.least(F.greatest(F.coalesce(F.when(near, linear).otherwise(relative), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * (fanout - 1))
    half = max(fanout // 2, 2)
    share = F.log1p(F.abs(v)) / F.log1p(F.greatest(F.abs(lo), F.abs(hi)))
    around = half + F.signum(v) * (1 + F.floor(share * (half - 2)))
    return F.when((lo > 0) | (hi < 0), one_sign).otherwise(around).cast("int")


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys), F.lit(True))


def _resolve(rows: DataFrame, keys: list[str], targets: DataFrame, fanout: int) -> DataFrame:
    """Bisection proper.  ``rows``: keys, lo = hi, n (a raw value has n = 1).  ``targets``: keys, rank
    (from 0), lo, hi, below.  Gives ``targets`` with every interval closed."""
    path = None
    while True:
        count = targets.where("lo < hi").count()
        if not count:
            return targets
        closed, targets = targets.where("lo >= hi"), targets.where("lo < hi")
        # ranks that still share an interval share its counts
        spans = targets.select(*keys, F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("below").alias("__below")).distinct()
        if count <= BROADCAST_ROWS:
            r, s, parts = rows.alias("r"), F.broadcast(spans).alias("s"), F.lit(True)
        else:
            # too many to broadcast: rows meet them by group and a part of the group, so that no hot group is one task's
            r = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(HOT_PARTS))).alias("r")
            s = spans.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HOT_PARTS - 1).cast("long")))).alias("s")
            parts = F.col("r.__salt") == F.col("s.__salt")
        inside = r.join(s, _same("r", "s", keys) & parts & (F.col("r.lo") >= F.col("s.__lo")) & (F.col("r.hi") <= F.col("s.__hi")))
        counts = (
            inside.select(*[F.col(f"r.{k}").alias(k) for k in keys], "__lo", "__hi", "__below", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"), "n")
            .withColumn("__part", _part(F.col("lo"), F.col("__lo"), F.col("__hi"), fanout))
            .groupBy(*keys, "__lo", "__hi", "__below", "__part")
            .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        )
        order = Window.partitionBy(*keys, "__lo", "__hi", "__below").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("below", F.col("__below") + F.coalesce(F.sum("n").over(order), F.lit(0)))
        c, t = counts.alias("c"), targets.alias("t")
        holds = (F.col("t.lo") == F.col("c.__lo")) & (F.col("t.hi") == F.col("c.__hi")) & (F.col("t.rank") >= F.col("c.below")) & (F.col("t.rank") < F.col("c.below") + F.col("c.n"))
        narrowed = t.join(c, _same("t", "c", keys) & holds).select(*[F.col(f"t.{k}").alias(k) for k in keys], "t.rank", "c.lo", "c.hi", "c.below")
        targets, path = rewritten(closed.unionByName(narrowed), path)


def exact_percentiles(df: DataFrame, keys: list[str], value: str | Column, percentiles: list[float], fanout: int = FANOUT) -> DataFrame:
    """One row per group: ``keys``, ``n`` (values that count) and ``p<100*q>`` for every q of ``percentiles``,
    interpolated linearly between the two nearest ranks; error 0.

    Null and NaN are no values; a group without any keeps its row with n = 0
    and null percentiles.  Infinities are values: beside an infinite rank the
    percentile is that infinity (the lower one of two).  Ties and repeated rows count each; null
    keys are groups; an empty table gives an empty table; with ``keys=[]`` the
    whole table is one group.  Columns of ``df`` outside ``keys`` never reach
    the result.

    Each pass is one scan with partial counts before its shuffle: at most
    ``fanout`` rows per open interval and task move, however large a group is.
    The intervals are broadcast while they are at most ``BROADCAST_ROWS``;
    beyond that every pass shuffles the values, each group in ``HOT_PARTS``
    parts.  Passes run while the query is built.
    """
    number = _value(value if isinstance(value, Column) else F.col(value))
    own = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    k = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*own, number.alias("lo")).withColumn("hi", F.col("lo")).withColumn("n", F.lit(1).cast("long"))
    return _percentiles(rows, k, percentiles, fanout).select(*[F.col(a).alias(b) for a, b in zip(k, keys)], "n", *[_name(q) for q in percentiles])


def _name(q: float) -> str:
    return "p" + f"{q * 100:g}".replace(".", "_")


def _percentiles(rows: DataFrame, k: list[str], percentiles: list[float], fanout: int) -> DataFrame:
    infinite = float("inf")
    low, high = F.col("lo") == -infinite, F.col("hi") == infinite
    total = F.coalesce(F.sum(F.when(F.col("lo").isNotNull(), F.col("n"))), F.lit(0))
    finite = ~low & ~high
    groups = rows.groupBy(*k).agg(
        total.alias("n"),
        F.coalesce(F.sum(F.when(low, F.col("n"))), F.lit(0)).alias("n_low"),
        F.coalesce(F.sum(F.when(high, F.col("n"))), F.lit(0)).alias("n_high"),
        F.min(F.when(finite, F.col("lo"))).alias("lo"),
        F.max(F.when(finite, F.col("hi"))).alias("hi"),
    )
    if not k:
        groups = groups.where(F.col("n") > 0)
    groups, _ = rewritten(groups)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("n") - 1) * q).cast("long"), F.ceil((F.col("n") - 1) * q).cast("long")) for q in percentiles])))
    wanted = groups.where(F.col("n") > 0).withColumn("rank", F.explode(ranks))
    beyond = F.when(F.col("rank") < F.col("n_low"), F.lit(-infinite)).when(F.col("rank") >= F.col("n") - F.col("n_high"), F.lit(infinite))
    targets = wanted.select(*k, F.col("rank"), F.coalesce(beyond, F.col("lo")).alias("lo"), F.coalesce(beyond, F.col("hi")).alias("hi"), F.col("n_low").alias("below"))
    closed = _resolve(rows.where(finite), k, targets, fanout)
    found = closed.groupBy(*k).agg(F.map_from_entries(F.collect_list(F.struct("rank", F.col("hi").alias("v")))).alias("__at"))
    g, f = groups.alias("g"), found.alias("f")
    joined = g.join(f, _same("g", "f", k), "left")
    out = []
    for q in percentiles:
        at = (F.col("g.n") - 1) * q
        below, above = F.try_element_at("f.__at", F.floor(at).cast("long")), F.try_element_at("f.__at", F.ceil(at).cast("long"))
        between = below + (above - below) * (at - F.floor(at))
        out.append(F.when((below == above) | (F.abs(below) == infinite), below).when(F.abs(above) == infinite, above).otherwise(between).alias(_name(q)))
    return joined.select(*[F.col(f"g.{x}").alias(x) for x in k], "g.n", *out)


def summarise(df: DataFrame, keys: list[str], value: str | Column, bits: int = SUMMARY_BITS) -> DataFrame:
    """The mergeable form: ``keys``, ``cell``, ``n``, ``lo``, ``hi``; one row per group and cell that holds a value.

    Cells divide every doubling of a value into ``2**bits`` equal parts, alike
    for negative values; zero and each infinity have cells of their own.  Null
    and NaN are no values.  A group of any size has at most about
    ``2**(bits+12)`` cells, in practice some hundreds.  ``merge`` adds
    summaries, ``summary_percentiles`` reads them.
    """
    number = _value(value if isinstance(value, Column) else F.col(value))
    rows = df.select(*keys, number.alias("__v")).where(F.col("__v").isNotNull())
    size = F.abs("__v")
    power = F.floor(F.log2(F.when(size > 0, size)))
    mantissa = F.floor((size / F.pow(F.lit(2.0), power) - 1) * (1 << bits))
    grid = (F.coalesce(power, F.lit(0)).cast("long") + 1100) * (1 << bits) + F.coalesce(mantissa, F.lit(0)).cast("long")
    cell = F.when(size == 0, 0).when(size == float("inf"), F.signum("__v").cast("long") * (1 << (bits + 13))).otherwise(F.signum("__v").cast("long") * grid)
    return rows.groupBy(*keys, cell.cast("long").alias("cell")).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))


def merge(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Adds summaries of days or partitions up to one per group of ``keys`` (any of the keys they were made with)."""
    return summaries.groupBy(*keys, "cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def summary_percentiles(summaries: DataFrame, keys: list[str], percentiles: list[float], fanout: int = FANOUT) -> DataFrame:
    """``keys``, ``n`` and ``p<100*q>`` as in ``exact_percentiles``, from summaries, which are merged first.

    Each rank's value is off by at most half the width of its cell, that is
    ``2**-(bits+1)`` of the value's magnitude; infinities, zeros and groups of equal
    values are exact.
    """
    k = [f"__k{i}" for i in range(len(keys))]
    rows = merge(summaries, keys).select(*[F.col(a).alias(b) for a, b in zip(keys, k)], "lo", "hi", "n")
    # a cell counts as its middle: half a cell's width is the most that can be wrong
    middle = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) / 2)
    rows = rows.withColumn("lo", middle).withColumn("hi", F.col("lo"))
    return _percentiles(rows, k, percentiles, fanout).select(*[F.col(a).alias(b) for a, b in zip(k, keys)], "n", *[_name(q) for q in percentiles])

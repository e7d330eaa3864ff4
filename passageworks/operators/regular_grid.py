"""Irregular readings put onto a regular grid of periods, gaps filled or marked.

Method: ``lead`` pairs each reading with the next one, only the grid times
between the two are exploded, each is interpolated or marked at once by the
length of its gap, and every source is extended to its first and last period.

A source may hold a third of all rows.  Readings are therefore reduced to one
per source and period before they are shuffled by source, and the series of a
source is paired in blocks of periods: what follows a block's last reading is
taken from a table with one row per source and block and stands beside the
block's own readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Periods of one block of a series.
BLOCK_PERIODS = 4096


def epoch_seconds(time: Column) -> Column:
    """Seconds of a zoneless timestamp since 1970, whatever the session's zone."""
    return F.unix_date(time.cast("date")).cast("long") * 86400 + F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)


def slot_start(slot: Column, step: int) -> Column:
    """Start of a period as a zoneless timestamp."""
    seconds = slot * step
    day, rest = F.floor(seconds / 86400).cast("int"), F.pmod(seconds, F.lit(86400))
    interval = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), rest.cast("decimal(18,6)"))
    return F.date_from_unix_date(day).cast("timestamp_ntz") + interval


def _valid(column: str) -> Column:
    return F.when(~F.isnan(column), F.col(column).cast("double"))


def regular_grid(
    df: DataFrame,
    metrics: list[str],
    source: str = "run_id",
    time: str = "timestamp",
    step: int = 10,
    longest_gap: int = 6,
    order: str | None = "recv_at",
    block: int = BLOCK_PERIODS,
) -> DataFrame:
    """One row per source, metric and period of ``step`` seconds: ``source, metric, slot timestamp_ntz,
    value double, status``.

    Periods start at whole multiples of ``step`` of the clock and reach from
    the one with the source's first non-null time to the one with its last.
    The value of a period is its last valid reading (by time, then ``order``,
    then value).  ``status`` is ``observed``; ``interpolated``, linearly, where
    at most ``longest_gap`` periods in a row are empty between two readings; or
    ``missing`` (null value) in longer gaps, before the first and after the
    last reading.

    Null and NaN are no values; rows with a null time belong to no period;
    repeated and late rows change nothing; a source without any value gets
    missing periods only; a null source is a source; an empty table gives an
    empty table; other columns are ignored.  The output columns have these
    names whatever ``df`` holds.
    """
    at = F.col(time)
    keep = [F.col(source).alias("__source"), at.alias("__time"), (F.col(order) if order else F.lit(0)).alias("__order")]
    rows = df.where(at.isNotNull()).select(*keep, *[_valid(m).alias(f"__v{i}") for i, m in enumerate(metrics)])
    rows = rows.withColumn("__slot", F.floor(epoch_seconds(F.col("__time")) / step).cast("long"))
    last = lambda v: F.max_by(F.when(v.isNotNull(), v), F.when(v.isNotNull(), F.struct("__time", "__order", v)))
    slots = rows.groupBy("__source", "__slot").agg(*[last(F.col(f"__v{i}")).alias(f"__v{i}") for i in range(len(metrics))])

    reading = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"__v{i}").alias("value")) for i, m in enumerate(metrics)])
    series = slots.select("__source", "__slot", F.inline(reading)).withColumn("__block", F.floor(F.col("__slot") / block))

    # one small row per source, metric and block: its first reading, the first one after it, and the ends of the source
    at_reading = F.when(F.col("value").isNotNull(), F.struct("__slot", "value"))
    blocks = series.groupBy("__source", "metric", "__block").agg(F.min(at_reading).alias("__head"), F.min("__slot").alias("__lo"), F.max("__slot").alias("__hi"))
    source_of = Window.partitionBy("__source", "metric")
    ordered = source_of.orderBy("__block")
    mark = lambda slot: F.struct(slot.cast("long").alias("__slot"), F.lit(None).cast("double").alias("value"))
    blocks = blocks.select(
        "__source", "metric", "__block", "__head", mark(F.min("__lo").over(source_of) - 1).alias("__begin"), mark(F.max("__hi").over(source_of) + 1).alias("__end"),
        F.expr("lead(__head) IGNORE NULLS OVER (PARTITION BY __source, metric ORDER BY __block)").alias("__after"),
        F.count("__head").over(ordered).alias("__upto"), F.count("__head").over(source_of).alias("__all"), F.row_number().over(ordered).alias("__place"),
    )
    # The mark before a source's first reading stands in that reading's block, or alone in the first block of a source
    # without any.  A block with either ends at a border: the next block's first reading, or the mark after the source.
    opens = F.col("__head").isNotNull() & (F.col("__upto") == 1) | (F.col("__all") == 0) & (F.col("__place") == 1)
    item = lambda at, border: F.struct(at.alias("at"), F.lit(border).alias("__border"))
    added = F.array_compact(F.array(F.when(opens, item(F.col("__begin"), False)), F.when(opens | F.col("__head").isNotNull(), item(F.coalesce("__after", "__end"), True))))
    bounds = blocks.select("__source", "metric", "__block", F.inline(added)).select("__source", "metric", "__block", "at.__slot", "at.value", "__border")
    readings = series.where(F.col("value").isNotNull()).select("__source", "metric", "__block", "__slot", "value", F.lit(False).alias("__border"))

    # marks and borders are given, so that no block needs to look into another one
    within = Window.partitionBy("__source", "metric", "__block").orderBy("__slot", "__border")
    paired = readings.unionByName(bounds).withColumn("__next", F.lead(F.struct("__slot", "value")).over(within)).where(~F.col("__border"))
    pairs = paired.select("__source", "metric", "__slot", "value", F.col("__next.__slot").alias("__to"), F.col("__next.value").alias("__to_value"))

    # a pair gives its own period, if it is no mark, and the empty ones up to the next reading;
    # a long gap is exploded block by block, so that no single array grows with it
    first = F.col("__slot") + F.when(F.col("value").isNull(), 1).otherwise(0)
    spread = pairs.where(F.col("__to") > first).withColumn("__from", F.explode(F.sequence(first, F.col("__to") - 1, F.lit(block))))
    spread = spread.withColumn("slot", F.explode(F.sequence("__from", F.least(F.col("__from") + (block - 1), F.col("__to") - 1))))
    own = F.col("slot") == F.col("__slot")
    fill = (F.col("__to") - F.col("__slot") <= longest_gap + 1) & F.col("value").isNotNull() & F.col("__to_value").isNotNull()
    share = (F.col("slot") - F.col("__slot")) / (F.col("__to") - F.col("__slot"))
    return spread.select(
        F.col("__source").alias(source), "metric", slot_start(F.col("slot"), step).alias("slot"),
        F.when(own, F.col("value")).when(fill, F.col("value") + (F.col("__to_value") - F.col("value")) * share).alias("value"),
        F.when(own, "observed").when(fill, "interpolated").otherwise("missing").alias("status"),
    )

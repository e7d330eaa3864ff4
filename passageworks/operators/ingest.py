"""Ingest of passages in batches: ordinals, statistics per batch, running and final totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passageworks.session import cut_lineage


def number_rows(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with ``pos``, from 0 by ``order``.

    Rows are laid out in ranges; each range numbers its own rows, and the
    counts of the ranges before it, one small row each, are added.  No task
    sees more than its range.  The layout is written to the shared folder
    while the query is built.
    """
    laid = df.withColumn("__order", F.struct(*order)).repartitionByRange(F.col("__order")).sortWithinPartitions("__order")
    # the low 33 bits count rows within a partition, the high ones name it
    numbered = cut_lineage(laid.withColumn("__id", F.monotonically_increasing_id()).drop("__order"))
    part = F.shiftright("__id", 33)
    counts = numbered.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = counts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    pos = (F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1)).alias("pos")
    out = numbered.withColumn("__part", part).join(F.broadcast(before), "__part")  # one row per partition
    return out.select(*df.columns, pos)


def assign_batches(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """``df`` with ``pos`` (from 0, by ``order``) and ``batch_idx`` of batches of ``size`` rows."""
    return number_rows(df, order).withColumn("batch_idx", F.floor(F.col("pos") / size).cast("int"))


def skips(chunks: DataFrame, batch: str, skipped: Column, digits: int = 6) -> DataFrame:
    """Per batch: chunks before the skip, skipped, kept, and the skip rate, 0 where there is nothing."""
    return chunks.groupBy(batch).agg(
        F.count("*").alias("n_before"),
        F.count_if(skipped).alias("n_skipped"),
        F.count_if(~skipped).alias("n_chunks"),
        F.round(F.coalesce(F.count_if(skipped) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), digits).alias("skip_rate"),
    )


def running_totals(batches: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Cumulative sums over the batches of each build; one row per batch, so a window is small."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return batches.select(key, order, *[F.sum(c).over(w).alias(f"running_{c}") for c in columns])


def running_lengths(batches: DataFrame, key: str, order: str, count: Column, mean: Column, least: Column, most: Column) -> DataFrame:
    """Cumulative count, sum, least and greatest chunk length over the batches of each build."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return batches.select(key, order, F.sum(count).over(w).alias("running_count"), F.sum(mean * count).over(w).alias("running_sum"), F.min(least).over(w).alias("running_min"), F.max(most).over(w).alias("running_max"))

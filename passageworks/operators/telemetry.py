"""Hardware samples: availability, derived columns, averages, and what fell into runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The metric columns of the sampler, and those it writes only where the tool is there.
METRICS = ["cpu_util_pct", "ram_used_mb", "ram_total_mb", "ram_avail_mb", "ram_used_pct", "disk_r_s", "disk_w_s", "disk_rkB_s", "disk_wkB_s", "disk_r_await_ms", "disk_w_await_ms", "disk_util_pct", "gpu_mem_used_mb", "gpu_mem_total_mb", "gpu_mem_free_mb", "gpu_util_pct"]
OPTIONAL = ["dcgmi_power_w", "dcgmi_gpu_util_pct", "dcgmi_nvlink_tx_mbs", "dcgmi_nvlink_rx_mbs", "dcgmi_pcie_tx_mbs", "dcgmi_pcie_rx_mbs"]


def availability(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, n_present, available``: all counted in one aggregation, then turned."""
    counts = df.agg(*[F.count(F.when(~F.isnan(c), F.col(c))).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "n_present").withColumn("available", F.col("n_present") > 0)


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, non_null, n_rows`` of any columns."""
    counts = df.agg(F.count("*").alias("n_rows"), *[F.count(c).alias(c) for c in columns])
    return counts.unpivot(["n_rows"], columns, "column", "non_null")


def derived(df: DataFrame) -> DataFrame:
    """Percentages from their parts: idle share from use, and used memory of the total."""
    total = F.nullif(F.col("ram_total_mb"), F.lit(0.0))
    return df.withColumn("cpu_idle_pct", 100 - F.col("cpu_util_pct")).withColumn("ram_pct", F.col("ram_used_mb") * 100 / total)


def in_runs(samples: DataFrame, runs: DataFrame, time: str = "timestamp", start: str = "start", end: str = "end", key: str = "trace_id", bucket_seconds: int = 300) -> DataFrame:
    """Samples within each run's interval, both ends included: ``key`` and the columns of the sample.

    A range join by time buckets: every run is listed under each bucket that it
    touches, a sample under its own, and the exact bounds are tested on what
    meets.  Runs with a null bound or the end before the start match nothing.
    """
    from passageworks.operators.regular_grid import epoch_seconds

    bucket = lambda t: F.floor(epoch_seconds(F.col(t)) / bucket_seconds).cast("long")
    spread = runs.where(F.col(end) >= F.col(start)).select(key, F.col(start).alias("__start"), F.col(end).alias("__end"), F.explode(F.sequence(bucket(start), bucket(end))).alias("__bucket"))
    own = samples.where(F.col(time).isNotNull()).withColumn("__bucket", bucket(time))
    return own.join(spread, "__bucket").where((F.col(time) >= F.col("__start")) & (F.col(time) <= F.col("__end"))).drop("__bucket", "__start", "__end")

"""Ingest as a stream: micro-batches of passage files into a chunk table and a trace table, restartable."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passageworks.functions.text import blank, metadata_of, strip
from passageworks.functions.vectors import invalid, norm
from passageworks.operators.embed import Embedder, HashEmbedder, embed_table
from passageworks.operators.evaluate import describe_by
from passageworks.operators.index import build_ivf
from passageworks.operators.ingest import skips
from passageworks.sources.readers import passages_of, read_lines, read_telemetry


TRACE = (
    "embedder_name string, n_passages long, n_chunks long, n_skipped long, skip_rate double, chars long, chunk_length struct<mean:double,min:double,max:double,p5:double,p95:double>, "
    "embed_norm struct<mean:double,min:double,max:double,std:double,p5:double,p95:double>, embed_ms double, index_ms double, embed_throughput struct<chunks_per_sec:double>"
)


def ingest_passages(spark: SparkSession, source: str, target: str, files_per_trigger: int = 1, embedder: Embedder | None = None, cells: DataFrame | None = None) -> StreamingQuery:
    """Passages of new files go chunked, embedded and, where ``cells`` are given, with their ``cell_id`` to
    ``target/chunks``; one trace row per micro-batch to ``target/batches``.

    Each micro-batch writes its own partition and overwrites it if it is run
    again, so a restart neither loses nor repeats anything.  Chunks that the
    embedder skips are counted and left out.  All columns but the text go into
    a chunk's metadata.
    """
    embedder = embedder or HashEmbedder()
    lines = read_lines(spark, source, stream=True, files_per_trigger=files_per_trigger)

    def write(batch: DataFrame, batch_id: int) -> None:
        at = f"batch_id={batch_id}"
        began = time.time()
        passages = metadata_of(passages_of(batch), "text").where(~blank("text"))
        own = passages.select(F.concat(F.lit("passage"), F.coalesce(F.col("metadata")["id"], F.lit(""))).alias("chunk_id"), strip("text").alias("text"), "metadata")
        embedded = embed_table(own.withColumn("row", F.struct("chunk_id", "text", "metadata")), "row", "text", embedder)
        embedded.select("row.*", "embedding").write.mode("overwrite").parquet(f"{target}/embedded/{at}")
        embed_ms = (time.time() - began) * 1000
        began = time.time()
        rows = spark.read.parquet(f"{target}/embedded/{at}")
        skipped = invalid("embedding", embedder.dimension)
        kept = rows.where(~skipped)
        (build_ivf(kept, cells, "chunk_id") if cells is not None else kept).write.mode("overwrite").parquet(f"{target}/chunks/{at}")
        index_ms = (time.time() - began) * 1000
        measured = rows.select(F.lit(1).alias("all"), F.length("text").alias("length"), F.when(~skipped, norm("embedding")).alias("norm"), skipped.alias("skipped"))
        described = lambda c: describe_by(measured, ["all"], c)
        stats = lambda name, *more: F.struct(*[F.col(f"{name}.{c}").alias(c) for c in ("mean", "min", "max")], *more, *[F.col(f"{name}.{c}").alias(c) for c in ("p5", "p95")])
        counts = measured.groupBy("all").agg(F.count("*").alias("n_passages"), F.sum(F.when(~F.col("skipped"), F.col("length"))).alias("chars"), F.stddev_pop("norm").alias("std"))
        joined = skips(measured, "all", F.col("skipped")).join(counts, "all").join(described("length").alias("l"), "all").join(described("norm").alias("n"), "all")  # one row each
        seconds = F.nullif(F.lit(embed_ms / 1000), F.lit(0.0))
        trace = joined.select(
            F.lit(embedder.name).alias("embedder_name"), "n_passages", "n_chunks", "n_skipped", "skip_rate", F.coalesce("chars", F.lit(0)).alias("chars"),
            stats("l").alias("chunk_length"), stats("n", F.coalesce("std", F.lit(0.0)).alias("std")).alias("embed_norm"), F.lit(embed_ms).alias("embed_ms"), F.lit(index_ms).alias("index_ms"),
            F.struct(F.coalesce(F.col("n_chunks") / seconds, F.lit(0.0)).alias("chunks_per_sec")).alias("embed_throughput"),
        )
        trace.coalesce(1).write.mode("overwrite").parquet(f"{target}/batches/{at}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()


def batch_traces(spark: SparkSession, target: str) -> DataFrame:
    """The trace rows of all micro-batches that are committed, by ``batch_id``."""
    return spark.read.schema(TRACE + ", batch_id long").parquet(f"{target}/batches")


def resume_state(spark: SparkSession, target: str) -> DataFrame:
    """Totals of what is committed: last batch, passages, chunks, skipped, characters, shortest and longest chunk, times."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return batch_traces(spark, target).agg(
        F.max("batch_id").alias("last_batch"), *map(total, ("n_passages", "n_chunks", "n_skipped", "chars")), F.min("chunk_length.min").cast("long").alias("least"), F.max("chunk_length.max").cast("long").alias("most"), *map(total, ("embed_ms", "index_ms"))
    )


def telemetry_windows(spark: SparkSession, source: str, target: str, minutes: int = 1) -> StreamingQuery:
    """Use per window as a stream of files: every micro-batch writes its sums and counts per window to ``target``.

    Sums add up, so that a sample counts however late it comes: nothing is
    held back and nothing dropped, and no state grows in memory.  A batch that
    is run again overwrites its own partition.  :func:`telemetry_averages`
    reads the averages.  Samples without a time belong to no window; null and
    NaN are no values.
    """
    rows = read_telemetry(spark, source, stream=True).where("timestamp IS NOT NULL")
    value = lambda c: F.when(~F.isnan(c), F.col(c))
    start = F.window(F.col("timestamp"), f"{minutes} minutes")["start"].alias("start")
    sums = [f(value(f"{c}_util_pct")).alias(f"{c}_{n}") for c in ("cpu", "gpu") for n, f in (("sum", F.sum), ("count", F.count))]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(start).agg(*sums, F.count("*").alias("n")).write.mode("overwrite").parquet(f"{target}/windows/batch_id={batch_id}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()


def telemetry_averages(spark: SparkSession, target: str) -> DataFrame:
    """``start, cpu, gpu, n`` of every window written so far."""
    sums = spark.read.parquet(f"{target}/windows").groupBy("start")
    mean = lambda c: (F.sum(f"{c}_sum") / F.nullif(F.sum(f"{c}_count"), F.lit(0))).alias(c)
    return sums.agg(mean("cpu"), mean("gpu"), F.sum("n").alias("n"))

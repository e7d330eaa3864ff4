"""Registered queries over latencies, ingest batches and telemetry, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from passageworks.functions import vectors as V
from passageworks.operators import evaluate as E
from passageworks.operators import ingest, telemetry
from passageworks.plans.corpus import folder
from passageworks.plans.retrieval import _traces
from passageworks.session import read_table
from passageworks.sources import readers

QUERIES, ORACLE = {}, {}
STAGES = ("embed", "retrieve", "rerank", "generate")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_T = "WITH t AS (SELECT * FROM run_traces QUALIFY row_number() OVER (PARTITION BY trace_id) = 1)"
_MS = lambda stage: f"CASE WHEN latency_ms['{stage}'] IS NULL OR isnan(latency_ms['{stage}']) THEN 0 ELSE latency_ms['{stage}'] END"
_L = _T + ", m AS (SELECT trace_id, pipeline, " + ", ".join(f"{_MS(s)} AS {s}" for s in STAGES) + " FROM t)"


def _latencies(spark, d):
    """Milliseconds of every stage of every run; a missing stage, null or NaN is 0."""
    ms = lambda s: F.coalesce(F.nanvl(F.try_element_at("latency_ms", F.lit(s)), F.lit(0.0)), F.lit(0.0)).alias(s)
    return _traces(spark, d).select("trace_id", "pipeline", *map(ms, STAGES))


@query(f"{_L} SELECT pipeline, count(*) AS n_runs, " + ", ".join(f"round(avg({s}), 6) AS {s}_mean" for s in STAGES) + " FROM m GROUP BY pipeline")
def latency_stats(spark, d):
    return _latencies(spark, d).groupBy("pipeline").agg(F.count("*").alias("n_runs"), *[F.round(F.avg(s), 6).alias(f"{s}_mean") for s in STAGES])


@query(f"""{_L}, u AS (UNPIVOT m ON {', '.join(STAGES)} INTO NAME stage VALUE ms),
    s AS (SELECT pipeline, stage, list_sort(list(ms)) AS v FROM u GROUP BY pipeline, stage)
    SELECT pipeline, stage, len(v)::bigint AS n, v[least(floor(len(v) * 0.95::double), len(v) - 1)::int + 1] AS p95 FROM s""")
def latency_p95(spark, d):
    long = _latencies(spark, d).unpivot(["pipeline"], list(STAGES), "stage", "ms")
    return E.p95(long, ["pipeline", "stage"], "ms")


@query(f"{_L} SELECT pipeline, " + ", ".join(f"round(coalesce(count(*) / nullif(sum({s}) / 1000, 0), 0), 6) AS {s}_qps" for s in STAGES) + " FROM m GROUP BY pipeline")
def throughput_qps(spark, d):
    qps = lambda s: F.round(F.coalesce(F.count("*") / F.nullif(F.sum(s) / 1000, F.lit(0.0)), F.lit(0.0)), 6).alias(f"{s}_qps")
    return _latencies(spark, d).groupBy("pipeline").agg(*map(qps, STAGES))


def _clock(name):
    return F.try_element_at("wall_time", F.lit(name))


@query(f"{_T} SELECT trace_id, (epoch_us(wall_time['pipeline_end']) - epoch_us(wall_time['pipeline_start'])) / 1000.0::double AS total_ms, (epoch_us(wall_time['pipeline_end']) - epoch_us(wall_time['generate_start'])) / 1000.0::double AS generate_ms FROM t")
def stage_latency(spark, d):
    # both ends lie in the same zone, so their difference does not depend on it
    ms = lambda a, b: (F.unix_micros(F.to_utc_timestamp(_clock(b).cast("timestamp"), "UTC")) - F.unix_micros(F.to_utc_timestamp(_clock(a).cast("timestamp"), "UTC"))) / 1000
    return _traces(spark, d).select("trace_id", ms("pipeline_start", "pipeline_end").alias("total_ms"), ms("generate_start", "pipeline_end").alias("generate_ms"))


@query(f"{_T} SELECT pipeline, arg_min(wall_time['pipeline_start'], trace_id)::varchar AS first_start, arg_max(wall_time['pipeline_end'], trace_id)::varchar AS last_end, count(*) AS n_runs FROM t GROUP BY pipeline")
def run_bounds(spark, d):
    bound = lambda f, name: f(F.when(_clock(name).isNotNull(), _clock(name)), F.when(_clock(name).isNotNull(), F.col("trace_id"))).cast("string")
    return _traces(spark, d).groupBy("pipeline").agg(bound(F.min_by, "pipeline_start").alias("first_start"), bound(F.max_by, "pipeline_end").alias("last_end"), F.count("*").alias("n_runs"))


@query(f"{_T} SELECT pipeline, min(wall_time['pipeline_start'])::varchar AS start, max(wall_time['pipeline_end'])::varchar AS end FROM t WHERE pipeline IS NOT NULL GROUP BY pipeline")
def report_times(spark, d):
    """Reports written as JSON, of which start and end are read again."""
    path = folder(spark, "report")
    iso = lambda c: F.translate(c.cast("string"), " ", "T")
    runs = _traces(spark, d).where("pipeline IS NOT NULL").groupBy("pipeline").agg(iso(F.min(_clock("pipeline_start"))).alias("pipeline_start"), iso(F.max(_clock("pipeline_end"))).alias("pipeline_end"), F.count("*").alias("n_samples"))
    readers.write_report(runs.withColumn("stages", F.struct("n_samples")), path)
    return readers.read_report_times(spark, path, False).select("pipeline", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"))


_TOKENS = "len(regexp_extract_all(answer, '[^ ]+'))"
_TPS = f"CASE WHEN {_TOKENS} > 0 AND latency_ms['generate'] > 0 AND NOT isnan(latency_ms['generate']) THEN {_TOKENS} / (latency_ms['generate'] * 1e6 / 1e9) END"


def _tokens():
    count = F.size(F.filter(F.split("answer", " "), lambda x: x != ""))
    ns = F.nanvl(F.try_element_at("latency_ms", F.lit("generate")), F.lit(None).cast("double")) * 1e6
    return F.when(F.col("answer").isNotNull(), count), ns


@query(f"{_T} SELECT trace_id, round({_TPS}, 6) AS tps FROM t")
def tokens_per_sec(spark, d):
    return _traces(spark, d).select("trace_id", F.round(E.tokens_per_second(*_tokens()), 6).alias("tps"))


@query(f"{_T} SELECT pipeline, round(avg({_TOKENS}), 6) AS tokens, round(avg({_TPS}), 4) AS tps FROM t GROUP BY pipeline")
def token_stats(spark, d):
    """Means over the runs that have the figure."""
    return _traces(spark, d).groupBy("pipeline").agg(F.round(F.avg(_tokens()[0]), 6).alias("tokens"), F.round(F.avg(E.tokens_per_second(*_tokens())), 4).alias("tps"))


# -------------------------------------------------------------------- ingest

_STATS = lambda x, name: f"round(coalesce(avg({x}), 0), 6) AS {name}_mean, coalesce(min({x}), 0)::double AS {name}_min, coalesce(max({x}), 0)::double AS {name}_max, round(coalesce(quantile_cont({x}, 0.05), 0), 6) AS {name}_p5, round(coalesce(quantile_cont({x}, 0.95), 0), 6) AS {name}_p95"
_NAMES = ("mean", "min", "max", "p5", "p95")


@query(f"SELECT config_id, count(*) AS n, {_STATS('length(text)', 'length')} FROM chunks GROUP BY config_id")
def batch_length_stats(spark, d):
    return _described(read_table(spark, d, "chunks").select("config_id", F.length("text").alias("length")), "config_id", "length", F.count("*"))


def _described(rows, key, value, n, *more):
    """Count and statistics of ``value`` by ``key``."""
    stats = E.describe_by(rows, [key], value, 6)
    counts = rows.groupBy(F.col(key).alias("__key")).agg(n.alias("n"), *more)
    joined = counts.join(stats, F.col("__key").eqNullSafe(F.col(key)))
    return joined.select(key, "n", *[F.col(c).alias(f"{value}_{c}") for c in _NAMES], *[c for c in counts.columns if c not in ("__key", "n")])


_V = "v AS (SELECT (vec_id // 1000)::bigint AS batch_idx, NOT coalesce(len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0, false) AS skipped, CASE WHEN len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 THEN sqrt(list_dot_product(embedding::double[], embedding::double[])) END AS norm FROM chunk_vectors)"


def _embedded(spark, d):
    skipped = V.invalid("embedding", 64)
    return read_table(spark, d, "chunk_vectors").select(F.floor(F.col("vec_id") / 1000).alias("batch_idx"), skipped.alias("skipped"), F.when(~skipped, V.norm("embedding")).alias("norm"))


@query(f"WITH {_V} SELECT batch_idx, count(norm) AS n, {_STATS('norm', 'norm')}, round(coalesce(stddev_pop(norm), 0), 6) AS norm_std FROM v GROUP BY batch_idx")
def batch_norm_stats(spark, d):
    return _described(_embedded(spark, d), "batch_idx", "norm", F.count("norm"), F.round(F.coalesce(F.stddev_pop("norm"), F.lit(0.0)), 6).alias("norm_std"))


@query(f"WITH {_V} SELECT batch_idx, count(*) AS n_before, count(*) FILTER (skipped) AS n_skipped, round(count(*) FILTER (skipped) / count(*)::double, 6) AS skip_rate FROM v GROUP BY batch_idx")
def skip_rate(spark, d):
    return ingest.skips(_embedded(spark, d), "batch_idx", F.col("skipped")).drop("n_chunks")


_B = "b AS (SELECT * FROM batch_traces QUALIFY row_number() OVER (PARTITION BY build_id, batch_idx) = 1)"
_SUMS = ("n_passages", "n_chunks", "n_skipped")


def _batches(spark, d):
    return read_table(spark, d, "batch_traces").dropDuplicates(["build_id", "batch_idx"])


@query(f"WITH {_B} SELECT build_id, batch_idx, " + ", ".join(f"(sum({c}) OVER w)::bigint AS running_{c}" for c in _SUMS) + " FROM b WINDOW w AS (PARTITION BY build_id ORDER BY batch_idx ROWS UNBOUNDED PRECEDING)")
def running_totals(spark, d):
    return ingest.running_totals(_batches(spark, d), "build_id", "batch_idx", list(_SUMS))


@query(f"WITH {_B} SELECT build_id, batch_idx, (sum(n_chunks) OVER w)::bigint AS running_count, round(sum(chunk_length.mean * n_chunks) OVER w, 3) AS running_sum, min(chunk_length.min) OVER w AS running_min, max(chunk_length.max) OVER w AS running_max FROM b WINDOW w AS (PARTITION BY build_id ORDER BY batch_idx ROWS UNBOUNDED PRECEDING)")
def running_lengths(spark, d):
    rows = ingest.running_lengths(_batches(spark, d), "build_id", "batch_idx", F.col("n_chunks"), F.col("chunk_length.mean"), F.col("chunk_length.min"), F.col("chunk_length.max"))
    return rows.withColumn("running_sum", F.round("running_sum", 3))


_EMBED_S = "CASE WHEN embed_throughput.chunks_per_sec > 0 THEN n_chunks / embed_throughput.chunks_per_sec END"


@query(f"WITH {_B} SELECT build_id, batch_idx, round(({_EMBED_S}) * 1000, 3) AS embed_ms, round(embed_throughput.chunks_per_sec, 6) AS batch_rate, round(sum(n_chunks) OVER w / sum({_EMBED_S}) OVER w, 6) AS build_rate, round(sum({_EMBED_S}) OVER w * 1000, 1) AS build_embed_ms FROM b WINDOW w AS (PARTITION BY build_id)")
def build_throughput(spark, d):
    """Chunks a second and milliseconds of embedding, of each batch and of its whole build."""
    rate = F.col("embed_throughput.chunks_per_sec")
    rows = _batches(spark, d).withColumn("s", F.when(rate > 0, F.col("n_chunks") / rate))
    totals = rows.groupBy("build_id").agg(F.round(F.sum("n_chunks") / F.sum("s"), 6).alias("build_rate"), F.round(F.sum("s") * 1000, 1).alias("build_embed_ms"))
    return rows.select("build_id", "batch_idx", F.round(F.col("s") * 1000, 3).alias("embed_ms"), F.round(rate, 6).alias("batch_rate")).join(totals, "build_id")


@query(f"""WITH {_B} SELECT build_id, n_passages, n_chunks, n_skipped, batch_idx, batch_chunks, batch_length FROM (
    SELECT build_id, sum(n_passages) OVER w::bigint AS n_passages, sum(n_chunks) OVER w::bigint AS n_chunks, sum(n_skipped) OVER w::bigint AS n_skipped, batch_idx, n_chunks AS batch_chunks, chunk_length.mean AS batch_length FROM b WINDOW w AS (PARTITION BY build_id))""")
def build_trace_json(spark, d):
    """Build traces with their batches inside, written as JSON and read again."""
    path = folder(spark, "builds")
    batch = F.struct("batch_idx", "n_passages", "n_chunks", "n_skipped", "skip_rate", "embed_throughput", "chunk_length", "embed_norm")
    # the batches of one build are one document, as many as it has micro-batches
    builds = _batches(spark, d).groupBy("build_id").agg(*[F.sum(c).alias(c) for c in _SUMS], F.array_sort(F.collect_list(batch)).alias("batches"))
    readers.write_report(builds, path)
    again = spark.read.schema(builds.schema).json(path)
    return again.select("build_id", *_SUMS, F.explode("batches").alias("b")).select("build_id", *_SUMS, "b.batch_idx", F.col("b.n_chunks").alias("batch_chunks"), F.col("b.chunk_length.mean").alias("batch_length"))


@query(f"""WITH {_B} SELECT build_id, count(*) AS n_batches, sum(n_passages)::bigint AS n_passages, sum(n_chunks)::bigint AS n_chunks, sum(n_skipped)::bigint AS n_skipped,
    round(coalesce(sum(chunk_length.mean * (n_chunks + n_skipped)) / nullif(sum(n_chunks + n_skipped), 0), 0), 1) AS length_mean, min(chunk_length.min) AS length_min, max(chunk_length.max) AS length_max, count(*) FILTER (is_training_batch) AS n_training FROM b GROUP BY build_id""")
def build_trace(spark, d):
    before = F.col("n_chunks") + F.col("n_skipped")
    mean = F.coalesce(F.sum(F.col("chunk_length.mean") * before) / F.nullif(F.sum(before), F.lit(0)), F.lit(0.0))
    return _batches(spark, d).groupBy("build_id").agg(
        F.count("*").alias("n_batches"), *[F.sum(c).alias(c) for c in _SUMS], F.round(mean, 1).alias("length_mean"),
        F.min("chunk_length.min").alias("length_min"), F.max("chunk_length.max").alias("length_max"), F.count_if("is_training_batch").alias("n_training"),
    )


# ----------------------------------------------------------------- telemetry


@query("SELECT run_id, node, \"timestamp\", cpu_util_pct FROM hardware WHERE \"timestamp\" IS NOT NULL")
def telemetry_load(spark, d):
    return read_table(spark, d, "hardware").where("timestamp IS NOT NULL").select("run_id", "node", "timestamp", "cpu_util_pct").orderBy("timestamp")


@query("SELECT \"timestamp\", count(*) AS n, round(avg(CASE WHEN isnan(gpu_util_pct) THEN NULL ELSE gpu_util_pct END), 6) AS gpu_util, round(avg(CASE WHEN isnan(gpu_mem_used_mb) THEN NULL ELSE gpu_mem_used_mb END), 6) AS gpu_mem FROM hardware WHERE \"timestamp\" IS NOT NULL GROUP BY \"timestamp\"")
def telemetry_avg(spark, d):
    mean = lambda c: F.round(F.avg(F.when(~F.isnan(c), F.col(c))), 6)
    return read_table(spark, d, "hardware").where("timestamp IS NOT NULL").groupBy("timestamp").agg(F.count("*").alias("n"), mean("gpu_util_pct").alias("gpu_util"), mean("gpu_mem_used_mb").alias("gpu_mem"))


@query("SELECT run_id, \"timestamp\", round(100 - cpu_util_pct, 6) AS cpu_idle_pct, round(ram_used_mb * 100 / nullif(ram_total_mb, 0), 6) AS ram_pct FROM hardware")
def telemetry_derived(spark, d):
    return telemetry.derived(read_table(spark, d, "hardware")).select("run_id", "timestamp", F.round("cpu_idle_pct", 6).alias("cpu_idle_pct"), F.round("ram_pct", 6).alias("ram_pct"))


@query(f"{_T} SELECT trace_id, count(*) AS n_samples, round(avg(CASE WHEN isnan(gpu_util_pct) THEN NULL ELSE gpu_util_pct END), 6) AS gpu_util FROM t JOIN hardware h ON h.\"timestamp\" BETWEEN wall_time['pipeline_start'] AND wall_time['pipeline_end'] GROUP BY trace_id")
def telemetry_in_run(spark, d):
    runs = _traces(spark, d).select("trace_id", _clock("pipeline_start").alias("start"), _clock("pipeline_end").alias("end"))
    inside = telemetry.in_runs(read_table(spark, d, "hardware").select("timestamp", "gpu_util_pct"), runs, bucket_seconds=30)
    return inside.groupBy("trace_id").agg(F.count("*").alias("n_samples"), F.round(F.avg(F.when(~F.isnan("gpu_util_pct"), F.col("gpu_util_pct"))), 6).alias("gpu_util"))


_ALL = [*telemetry.METRICS, *telemetry.OPTIONAL]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NOT NULL AND NOT isnan({c})) AS n_present, count(*) FILTER ({c} IS NOT NULL AND NOT isnan({c})) > 0 AS available FROM hardware" for c in _ALL))
def col_available(spark, d):
    return telemetry.availability(read_table(spark, d, "hardware"), _ALL)

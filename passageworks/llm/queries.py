"""Registered queries of the ``llm`` operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.llm import leakage, neighbours, percentiles, residue, splitting, tokens
from passageworks.session import read_table

PERCENTILES = [0.5, 0.9, 0.95, 0.99]


def _stages(spark: SparkSession, d: str) -> DataFrame:
    """One row per run and stage; the day is that of the run's start, whenever it was received."""
    day = F.to_date(F.try_element_at("wall_time", F.lit("pipeline_start"))).alias("day")
    return read_table(spark, d, "run_traces").select("pipeline", day, F.explode("latency_ms").alias("stage", "ms"))


def _batch_measures(spark: SparkSession, d: str) -> DataFrame:
    entry = lambda name, c: F.struct(F.lit(name).alias("measure"), c.alias("value"))
    both = F.array(entry("chunk_length_p95", F.col("chunk_length.p95")), entry("embed_norm_p95", F.col("embed_norm.p95")))
    return read_table(spark, d, "batch_traces").select("embedder_name", F.inline(both))


def p1_latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.exact_percentiles(_stages(spark, d), ["pipeline", "stage", "day"], "ms", PERCENTILES)


def p1_batch_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.exact_percentiles(_batch_measures(spark, d), ["embedder_name", "measure"], "value", PERCENTILES)


def p1_latency_summaries(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.summarise(_stages(spark, d), ["pipeline", "stage", "day"], "ms")


def p1_latency_combined(spark: SparkSession, d: str) -> DataFrame:
    """All days together, from the daily summaries alone."""
    return percentiles.summary_percentiles(p1_latency_summaries(spark, d), ["pipeline", "stage"], PERCENTILES)


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    configs = read_table(spark, d, "chunker_configs")
    return splitting.split_oversized(read_table(spark, d, "chunks").join(configs, "config_id", "left"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = p2_pieces(spark, d).where((F.col("status") == "split") & (F.col("piece_idx") == 0))
    return pieces.select("chunk_id").distinct()


def p2_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every text joined again without their overlaps, and whether each is within its limit."""
    configs = read_table(spark, d, "chunker_configs")
    rows = read_table(spark, d, "chunks").select("chunk_id", "config_id", "text").where("text IS NOT NULL").distinct().join(configs, "config_id")
    keyed = rows.withColumn("key", F.struct("chunk_id", "config_id", F.md5("text").alias("of"), "chunk_size", "chunk_overlap"))
    pieces = splitting.split_oversized(keyed, "key")
    own = F.when(F.col("piece_idx") == 0, F.col("piece")).otherwise(F.expr("substring(piece, key.chunk_overlap + 1)"))
    # the pieces of one text are its own length
    joined = pieces.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("piece_idx", own.alias("own")))).alias("parts"), F.max(F.length("piece")).alias("longest"))
    return joined.select("key.chunk_id", "key.config_id", F.array_join(F.col("parts")["own"], "").alias("text"), (F.col("longest") <= F.col("key.chunk_size")).alias("fits"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = neighbours.similar(read_table(spark, d, "chunk_vectors"), floor=0.88)
    return found.select(F.least("vec_id", "neighbour").alias("vec_id_a"), F.greatest("vec_id", "neighbour").alias("vec_id_b")).distinct()


def p4_similar(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar of every vector whose id is divisible by 20, among all vectors."""
    found = neighbours.similar(read_table(spark, d, "chunk_vectors"), queries=lambda x: x % 20 == 0, recall=0.95)
    return found.withColumns({c: F.round(c, 5) for c in ("cosine", "score")})


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(read_table(spark, d, "documents"))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id").distinct()


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with the leaked spans taken out."""
    return leakage.remove_leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items")).select("doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(read_table(spark, d, "documents")).select("doc_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """How the classifier does on hosts that it has not seen, against the weak labels, and on sentences judged by hand."""
    model = residue.train(read_table(spark, d, "documents"))
    columns = ["fitted_on", "held_out", "precision", "recall", "judged", "judged_precision", "judged_recall"]
    return spark.createDataFrame([tuple(getattr(model, c) for c in columns)], columns)


QUERIES = {f.__name__: f for f in (p1_latency_percentiles, p1_batch_percentiles, p1_latency_summaries, p1_latency_combined, p2_found, p2_pieces, p2_rejoined, p4_found, p4_similar, p6_ids, p7_found, p7_leaks, p7_clean, p8_found, p8_report)}

_CONTINUOUS = ", ".join(f"quantile_cont(v, {q}) AS {percentiles._name(q)}" for q in PERCENTILES)

# every usable vector against every other, outright
_NEAREST = """
        f AS (SELECT DISTINCT vec_id, embedding::double[] AS v FROM chunk_vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM f WHERE list_dot_product(v, v) > 0),
        p AS (SELECT x.vec_id AS a, y.vec_id AS b, least(list_dot_product(x.v, y.v), 1.0) AS cosine FROM u x JOIN u y ON x.vec_id <> y.vec_id),
        r AS (SELECT a, b, cosine, row_number() OVER (PARTITION BY a ORDER BY round(cosine, 7) DESC, b) AS rk FROM p)"""

_CELL = f"""
        e AS (SELECT pipeline, CAST(wall_time['pipeline_start'] AS date) AS day, unnest(map_entries(latency_ms)) AS e FROM run_traces),
        x AS (SELECT pipeline, day, e.key AS stage, e.value AS v FROM e WHERE e.value IS NOT NULL AND NOT isnan(e.value)),
        c AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE sign(v) * ((floor(log2(abs(v))) + 1100) * {1 << percentiles.SUMMARY_BITS} + floor((abs(v) / pow(2, floor(log2(abs(v)))) - 1) * {1 << percentiles.SUMMARY_BITS})) END::bigint AS cell FROM x)"""
_AT = lambda rank: f"max(m) FILTER (upto > {rank} AND upto - n <= {rank})"
_OF_CELLS = ", ".join(f"{_AT(f'floor((total - 1) * {q}::double)')} + ({_AT(f'ceil((total - 1) * {q}::double)')} - {_AT(f'floor((total - 1) * {q}::double)')}) * ((max(total) - 1) * {q}::double - floor((max(total) - 1) * {q}::double)) AS {percentiles._name(q)}" for q in PERCENTILES)

ORACLE = {
    "p1_latency_summaries": f"WITH {_CELL} SELECT pipeline, stage, day, cell, count(*) AS n, min(v) AS lo, max(v) AS hi FROM c GROUP BY pipeline, stage, day, cell",
    "p1_latency_combined": f"""
        WITH {_CELL}, s AS (SELECT pipeline, stage, cell, count(*) AS n, min(v) + (max(v) - min(v)) / 2 AS m FROM c GROUP BY pipeline, stage, cell),
        t AS (SELECT *, sum(n) OVER (PARTITION BY pipeline, stage ORDER BY cell)::bigint AS upto, sum(n) OVER (PARTITION BY pipeline, stage)::bigint AS total FROM s)
        SELECT pipeline, stage, max(total)::bigint AS n, {_OF_CELLS} FROM t GROUP BY pipeline, stage""",
    "p1_latency_percentiles": f"""
        WITH e AS (SELECT pipeline, CAST(wall_time['pipeline_start'] AS date) AS day, unnest(map_entries(latency_ms)) AS e FROM run_traces),
        x AS (SELECT pipeline, day, e.key AS stage, CASE WHEN isnan(e.value) THEN NULL ELSE e.value END AS v FROM e)
        SELECT pipeline, stage, day, count(v) AS n, {_CONTINUOUS} FROM x GROUP BY pipeline, stage, day""",
    "p1_batch_percentiles": f"""
        WITH x AS (SELECT embedder_name, 'chunk_length_p95' AS measure, chunk_length.p95 AS v FROM batch_traces
                   UNION ALL SELECT embedder_name, 'embed_norm_p95', embed_norm.p95 FROM batch_traces),
        y AS (SELECT embedder_name, measure, CASE WHEN isnan(v) THEN NULL ELSE v END AS v FROM x)
        SELECT embedder_name, measure, count(v) AS n, {_CONTINUOUS} FROM y GROUP BY embedder_name, measure""",
    "p2_rejoined": "SELECT DISTINCT chunk_id, config_id, text, true AS fits FROM chunks JOIN chunker_configs USING (config_id) WHERE text IS NOT NULL",
    "p2_found": """
        SELECT DISTINCT chunk_id FROM chunks JOIN chunker_configs USING (config_id) WHERE length(text) > chunk_size""",
    "p4_found": f"""
        WITH {_NEAREST} SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM r WHERE rk <= 10 AND cosine >= 0.88""",
    "p4_similar": f"""
        WITH {_NEAREST} SELECT a AS vec_id, b AS neighbour, rk::int AS rank, round(cosine, 5) AS cosine, round((cosine + 1) / 2, 5) AS score FROM r WHERE rk <= 10 AND a % 20 = 0""",
    "p7_found": """
        WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda t: lower(t)) AS w FROM documents WHERE text IS NOT NULL),
        i AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda t: lower(t)) AS w FROM eval_items WHERE text IS NOT NULL),
        dw AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS k FROM w WHERE len(w) >= 12),
        iw AS (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 12),
        dn AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM dw),
        it AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM iw)
        SELECT DISTINCT doc_id, item_id FROM dn JOIN it USING (g)""",
}

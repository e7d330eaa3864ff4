"""Registered queries over passages, chunks and questions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.functions import text as T
from passageworks.operators import answers, chunking, ingest
from passageworks.operators.embed import hash_embed
from passageworks.operators.telemetry import METRICS, OPTIONAL, null_profile
from passageworks.session import new_folder as folder
from passageworks.session import read_table
from passageworks.sources import readers
from passageworks.streaming.ingest import ingest_passages, telemetry_averages, telemetry_windows
from passageworks.streaming.ingest import resume_state as stream_state

QUERIES, ORACLE = {}, {}
BATCH_ROWS = 64


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{T.WHITE}+|{T.WHITE}+$', '', 'g')"


def sql_normalise(x: str) -> str:
    return f"regexp_replace({sql_strip(f'lower({x})')}, '{T.WHITE}+', ' ', 'g')"


def sql_bare(x: str) -> str:
    return f"regexp_replace({sql_normalise(x)}, '[^\\p{{L}}\\p{{N}}_ ]', '', 'g')"


def sql_blank(x: str) -> str:
    return f"coalesce({sql_strip(x)} = '', true)"


# ------------------------------------------------------------------ passages


@query(f"SELECT id, text FROM passages WHERE NOT {sql_blank('text')}")
def filter_nonblank(spark, d):
    return read_table(spark, d, "passages").where(~T.blank("text")).select("id", "text")


@query(f"SELECT id, title FROM passages WHERE {sql_blank('text')}")
def filter_blank(spark, d):
    return read_table(spark, d, "passages").where(T.blank("text")).select("id", "title")


@query(f"SELECT id FROM passages WHERE text IS NULL OR lower({sql_strip('text')}) IN ('null', 'none', 'nan', 'n/a', 'na', '')")
def null_text(spark, d):
    return read_table(spark, d, "passages").where(T.null_like("text")).select("id")


@query("SELECT id, title, CASE WHEN title IS NULL THEN 1 ELSE 2 END AS n_fields FROM passages")
def meta_build(spark, d):
    """The map of all columns but the text, without those that are null."""
    metadata = T.metadata_of(read_table(spark, d, "passages"), "text")
    field = lambda name: F.try_element_at("metadata", F.lit(name)).alias(name)
    return metadata.select(field("id"), field("title"), F.size("metadata").alias("n_fields"))


@query("SELECT chunk_id, text, metadata['id'] AS meta_id, metadata['title'] AS meta_title FROM chunks")
def meta_split(spark, d):
    return read_table(spark, d, "chunks").select("chunk_id", "text", F.try_element_at("metadata", F.lit("id")).alias("meta_id"), F.try_element_at("metadata", F.lit("title")).alias("meta_title"))


@query("SELECT chunk_id, config_id::varchar AS config, coalesce(metadata['title'], '') AS title FROM chunks")
def map_merge(spark, d):
    own = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    added = F.create_map(F.lit("config"), F.col("config_id").cast("string"))
    # the later map wins, whatever the session's policy for equal keys
    merged = F.map_concat(F.map_filter(own, lambda k, v: k != "config"), added)
    return read_table(spark, d, "chunks").select("chunk_id", F.try_element_at(merged, F.lit("config")).alias("config"), F.coalesce(F.try_element_at(merged, F.lit("title")), F.lit("")).alias("title"))


_ORDERED = f"SELECT id, ((row_number() OVER (ORDER BY id NULLS FIRST, text NULLS FIRST, title NULLS FIRST) - 1) // {BATCH_ROWS})::int AS batch_idx FROM passages WHERE NOT {sql_blank('text')}"


@query(f"SELECT id, (row_number() OVER (ORDER BY id NULLS FIRST, text NULLS FIRST, title NULLS FIRST) - 1)::bigint AS pos FROM passages WHERE NOT {sql_blank('text')}")
def insertion_ids(spark, d):
    """The numbers that passages get in a store, from 0 without a gap."""
    rows = read_table(spark, d, "passages").where(~T.blank("text"))
    return ingest.number_rows(rows, [F.col("id"), F.col("text"), F.col("title")]).select("id", "pos")


@query("SELECT doc_id, replace(substring(text, 1, 80), chr(10), ' ') AS preview FROM documents")
def preview(spark, d):
    return read_table(spark, d, "documents").select("doc_id", T.preview("text").alias("preview"))


@query(_ORDERED)
def batch_assign(spark, d):
    rows = read_table(spark, d, "passages").where(~T.blank("text"))
    return ingest.assign_batches(rows, [F.col("id"), F.col("text"), F.col("title")], BATCH_ROWS).select("id", "batch_idx")


@query(f"SELECT * FROM ({_ORDERED}) WHERE batch_idx >= 3")
def resume_skip(spark, d):
    return batch_assign(spark, d).where("batch_idx >= 3")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def head_n(spark, d):
    return read_table(spark, d, "documents").select("doc_id").orderBy("doc_id").limit(100)


@query("SELECT 'documents' AS store, count(*) AS n FROM documents UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'chunk_vectors', count(*) FROM chunk_vectors")
def store_size(spark, d):
    one = lambda name: read_table(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n")
    return one("documents").unionByName(one("chunks")).unionByName(one("chunk_vectors"))


def _sql_chunks(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""
        WITH w AS (SELECT doc_id, text, unnest(generate_series(0, greatest(ceil((length(text) - {size}) / {step}.0), 0)::bigint)) AS chunk_idx FROM documents WHERE length(text) > 0),
        c AS (SELECT doc_id, chunk_idx::int AS chunk_idx, {sql_strip(f'substring(text, chunk_idx * {step} + 1, {size})')} AS chunk_text FROM w)
        SELECT doc_id, chunk_idx, 'doc' || doc_id || '_chunk' || chunk_idx AS chunk_id, chunk_text FROM c WHERE chunk_text <> ''"""


@query(_sql_chunks(512, 0))
def chunk_fixed(spark, d):
    return chunking.chunk_fixed(read_table(spark, d, "documents"), "doc_id", "text", 512, 0)


@query(_sql_chunks(512, 64))
def chunk_overlap(spark, d):
    return chunking.chunk_fixed(read_table(spark, d, "documents"), "doc_id", "text", 512, 64)


@query(f"SELECT id, 'passage' || id AS chunk_id, {sql_strip('text')} AS chunk_text FROM passages WHERE NOT {sql_blank('text')}")
def chunk_prechunked(spark, d):
    return chunking.chunk_prechunked(read_table(spark, d, "passages"), "id", "text")


@query("""
    WITH w AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')) AS w FROM documents),
    h AS (SELECT doc_id, md5(w) AS h FROM w)
    SELECT doc_id, ('0x' || substr(h, 1, 8))::bigint % 64 AS bucket, sum(CASE WHEN ('0x' || substr(h, 9, 8))::bigint % 2 = 0 THEN 1 ELSE -1 END)::bigint AS v FROM h GROUP BY ALL""")
def embed_hash(spark, d):
    return hash_embed(read_table(spark, d, "documents"), "doc_id", "text")


@query(f"SELECT doc_id, {sql_normalise('text')} AS value FROM documents")
def normalise(spark, d):
    return read_table(spark, d, "documents").select("doc_id", T.normalise("text").alias("value"))


# ----------------------------------------------------------------- questions

_NA = ", ".join(f"'{x}'" for x in T.NA_VALUES)
_QA = f"""
    WITH q AS (SELECT sample_id, query, CASE WHEN gold_answer NOT IN ({_NA}) THEN gold_answer END AS s, CASE WHEN all_answers[2] NOT IN ({_NA}) THEN all_answers[2] END AS l FROM qa_samples)
    SELECT sample_id, query, coalesce(s, l) AS gold_answer, list_filter([s, l], lambda x: x IS NOT NULL) AS all_answers FROM q WHERE s IS NOT NULL OR l IS NOT NULL"""


def _questions(spark, d):
    rows = read_table(spark, d, "qa_samples").withColumn("long", F.try_element_at("all_answers", F.lit(2)))
    return readers.load_questions(rows, "query", "gold_answer", "long", "sample_id")


@query(f"SELECT sample_id, query, gold_answer, len(all_answers)::int AS n_answers FROM ({_QA})")
def load_qa(spark, d):
    return _questions(spark, d).select("sample_id", "query", "gold_answer", F.size("all_answers").alias("n_answers"))


@query(f"SELECT query, gold_answer, len(all_answers)::int AS n_answers FROM ({_QA})")
def scan_questions(spark, d):
    """The same from a file of questions with short and long answers."""
    path = folder(spark, "questions")
    rows = read_table(spark, d, "qa_samples").select(F.col("query").alias("question"), F.col("gold_answer").alias("short_answers"), F.try_element_at("all_answers", F.lit(2)).alias("long_answers"))
    rows.write.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return readers.read_questions(spark, path).select("query", "gold_answer", F.size("all_answers").alias("n_answers"))


@query(f"SELECT sample_id, gold_answer AS gold FROM ({_QA})")
def gold_coalesce(spark, d):
    return _questions(spark, d).select("sample_id", F.col("gold_answer").alias("gold"))


@query(f"SELECT sample_id, all_answers[1] AS first, all_answers[2] AS second FROM ({_QA})")
def answers_array(spark, d):
    at = lambda i: F.try_element_at("all_answers", F.lit(i))
    return _questions(spark, d).select("sample_id", at(1).alias("first"), at(2).alias("second"))


@query("""SELECT count(*) AS n_samples, count(gold_answer) AS n_gold, count(*) FILTER (len(all_answers) > 0) AS n_answers, coalesce(bool_or(gold_answer IS NOT NULL), false) AS has_labels FROM qa_samples""")
def label_coverage(spark, d):
    q = read_table(spark, d, "qa_samples")
    return q.agg(F.count("*").alias("n_samples"), F.count("gold_answer").alias("n_gold"), F.count_if(F.size("all_answers") > 0).alias("n_answers"), F.coalesce(F.bool_or(F.col("gold_answer").isNotNull()), F.lit(False)).alias("has_labels"))


@query(f"""
    WITH a AS (SELECT DISTINCT sample_id, {sql_normalise('gold_answer')} AS a FROM qa_samples WHERE gold_answer IS NOT NULL),
    t AS (SELECT DISTINCT chunk_id, {sql_normalise('text')} AS t FROM chunks WHERE text IS NOT NULL)
    SELECT DISTINCT chunk_id, sample_id FROM t, a WHERE a.a <> '' AND t.t <> '' AND contains(t.t, a.a)""")
def answer_bearing_docs(spark, d):
    return answers.find_answers(read_table(spark, d, "chunks"), read_table(spark, d, "qa_samples"), "chunk_id", "text", "sample_id", "gold_answer")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS int) AS k FROM events")
def json_times(spark, d):
    return read_table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


_PROFILED = ["doc_id", "text", "lang", "source", "n_chars", "title", "kind", "fetched_at"]


@query(" UNION ALL ".join(f"SELECT count(*) AS n_rows, '{c}' AS \"column\", count({c}) AS non_null FROM documents" for c in _PROFILED))
def profile_nulls(spark, d):
    return null_profile(read_table(spark, d, "documents"), _PROFILED)


# ------------------------------------------------------ files and the stream


@query(f"SELECT coalesce(id, '') AS id, text, coalesce(title, '') AS title FROM passages WHERE NOT {sql_blank('text')}")
def scan_passages(spark, d):
    """Passages written as quoted, tab-separated files and read again."""
    path = folder(spark, "passages")
    readers.write_passages(read_table(spark, d, "passages").select("id", "text", "title"), path)
    return readers.read_passages(spark, path)


_KEPT = f"SELECT {sql_strip('text')} AS text, regexp_matches(lower(text), '[a-z0-9]') AS embedded FROM passages WHERE NOT {sql_blank('text')}"


@query(f"WITH k AS ({_KEPT}) SELECT 3::bigint AS last_batch, count(*) AS n_passages, count(*) FILTER (embedded) AS n_chunks, count(*) FILTER (NOT embedded) AS n_skipped, sum(length(text)) FILTER (embedded)::bigint AS chars, min(length(text))::bigint AS least, max(length(text))::bigint AS most FROM k")
def resume_state(spark, d):
    """Passage files through the stream, chunked, embedded and traced; a second start finds nothing left to do."""
    path = folder(spark, "stream")
    readers.write_passages(read_table(spark, d, "passages").select("id", "text", "title").repartition(4), f"{path}/source")
    for _ in range(2):
        ingest_passages(spark, f"{path}/source", f"{path}/target").awaitTermination()
    return stream_state(spark, f"{path}/target").drop("embed_ms", "index_ms")


_MINUTE = lambda c: f"round(avg(CASE WHEN isnan({c}) THEN NULL ELSE {c} END), 6)"


@query(f"""SELECT date_trunc('minute', "timestamp")::varchar AS start, {_MINUTE('cpu_util_pct')} AS cpu, {_MINUTE('gpu_util_pct')} AS gpu, count(*) AS n FROM hardware WHERE "timestamp" IS NOT NULL GROUP BY ALL""")
def telemetry_stream(spark, d):
    """Samples written as files, read as a stream in several micro-batches and averaged by minute."""
    path = folder(spark, "telemetry")
    samples = read_table(spark, d, "hardware").select("timestamp", *METRICS, *OPTIONAL)
    samples.write.options(header=True, timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(f"{path}/source")
    telemetry_windows(spark, f"{path}/source", f"{path}/target").awaitTermination()
    rows = telemetry_averages(spark, f"{path}/target")
    return rows.select(F.col("start").cast("string").alias("start"), F.round("cpu", 6).alias("cpu"), F.round("gpu", 6).alias("gpu"), "n")

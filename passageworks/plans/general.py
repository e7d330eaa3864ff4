"""Registered queries of the general data-quality operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.functions.text import WHITE
from passageworks.operators.parsing import parse_passages
from passageworks.operators.regular_grid import regular_grid
from passageworks.session import new_folder, read_table
from passageworks.sources.readers import load_passages

METRICS = ["gpu_util_pct", "ram_used_mb"]


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).withColumn("value", F.round("value", 6))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(read_table(spark, d, "hardware"), METRICS)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    slot = F.translate(F.col("slot").cast("string"), " ", "T").alias("slot")
    return _grid(spark, d).where(F.col("status") != "observed").select("run_id", "metric", slot)


def p5_parsed(spark: SparkSession, d: str) -> DataFrame:
    return parse_passages(read_table(spark, d, "raw_passages"))


def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    return p5_parsed(spark, d).where(F.col("reason").isNull()).select("rec_no", "id", "text", "title")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_parsed(spark, d).where(F.col("reason").isNotNull()).select("rec_no", "reason")


def p5_assembled(spark: SparkSession, d: str) -> DataFrame:
    """Proper records written as files, several a shard, and loaded from their lines.

    In every file the records that may span lines come first, then one whose
    quote is never closed, then those of one line; the open quote must cost
    none of them.
    """
    path = new_folder(spark, "shards")
    proper = p5_parsed(spark, d).where("reason IS NULL").select("rec_no").join(read_table(spark, d, "raw_passages"), "rec_no")
    simple = F.col("raw").rlike(r'^[0-9]{1,18}\t("([^"]|"")*"|[^"\t][^\t]*)\t("([^"]|"")*"|[^"\t][^\t]*|)$') & ~F.col("raw").rlike(r"[\n\r]")
    file = F.concat_ws("-", F.coalesce("shard", F.lit("none")), (F.col("rec_no") % 8).cast("string")).alias("file")
    rows = proper.select(file, simple.alias("simple"), "rec_no", "raw")
    open_quotes = rows.groupBy("file").agg(F.count_if("simple").alias("n")).where("n >= 3").select("file", F.lit(True).alias("simple"), F.lit(-1).cast("long").alias("rec_no"), F.lit('7\t"never closed').alias("raw"))
    rows.unionByName(open_quotes).repartition("file").sortWithinPartitions("file", "simple", "rec_no").select("file", "raw").write.option("lineSep", "\n").partitionBy("file").text(path)
    loaded = load_passages(spark, f"{path}/*", header=None)
    return loaded.groupBy("reason", "id", "text", "title").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (p3_found, p3_grid, p5_found, p5_loaded, p5_assembled)}

_H = """
    WITH h AS (
        SELECT run_id, 'gpu_util_pct' AS metric, epoch(date_trunc('second', "timestamp"))::bigint // 10 AS s, gpu_util_pct AS v FROM hardware WHERE "timestamp" IS NOT NULL
        UNION ALL
        SELECT run_id, 'ram_used_mb', epoch(date_trunc('second', "timestamp"))::bigint // 10, ram_used_mb FROM hardware WHERE "timestamp" IS NOT NULL),
    b AS (SELECT run_id, metric, min(s) AS a, max(s) AS z FROM h GROUP BY run_id, metric),
    g AS (SELECT run_id, metric, unnest(generate_series(a, z)) AS s FROM b),
    x AS (SELECT DISTINCT run_id, metric, s FROM h WHERE v IS NOT NULL AND NOT isnan(v))"""

# a field is quoted, or does not begin with a quote; a record is such fields between tabs
_FIELD = r'"(?:[^"]|"")*"|[^"\t][^\t]*|'
_UNQUOTED = ", ".join(f"""CASE WHEN x.{c} LIKE '"%' THEN replace(x.{c}[2:-2], '""', '"') ELSE x.{c} END AS {c}""" for c in "itn")
_R = rf"""
    WITH f AS (SELECT rec_no, raw, regexp_full_match(raw, '(?:{_FIELD})(?:\t(?:{_FIELD}))*') AS quoted, regexp_full_match(raw, '(?:{_FIELD})\t(?:{_FIELD})\t(?:{_FIELD})') AS three,
        regexp_extract(raw, '^({_FIELD})\t({_FIELD})\t({_FIELD})$', ['i', 't', 'n']) AS x FROM raw_passages),
    u AS (SELECT rec_no, raw, quoted, three, {_UNQUOTED} FROM f),
    r AS (SELECT *, CASE WHEN raw IS NULL OR raw = '' THEN 'columns' WHEN NOT quoted THEN 'quoting' WHEN NOT three THEN 'columns'
        WHEN NOT regexp_full_match(i, '[0-9]{{1,18}}') OR regexp_full_match(t, '{WHITE}*') OR regexp_matches(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{{fffd}}]') THEN 'value' END AS reason FROM u)"""

ORACLE = {
    "p5_found": f"{_R} SELECT rec_no, reason FROM r WHERE reason IS NOT NULL",
    "p5_assembled": rf"""{_R},
        f3 AS (SELECT coalesce(shard, 'none') || '-' || (rec_no % 8) AS file FROM raw_passages JOIN r USING (rec_no) WHERE reason IS NULL
            AND regexp_full_match(r.raw, '[0-9]{{1,18}}\t(?:{_FIELD})\t(?:{_FIELD})') AND NOT regexp_matches(r.raw, '[\n\r]') GROUP BY file HAVING count(*) >= 3)
        SELECT reason, i::bigint AS id, t AS text, n AS title, count(*) AS n FROM r WHERE reason IS NULL GROUP BY ALL
        UNION ALL SELECT 'quoting', NULL, NULL, NULL, count(*) FROM f3 HAVING count(*) > 0""",
    "p5_loaded": f"{_R} SELECT rec_no, i::bigint AS id, t AS text, n AS title FROM r WHERE reason IS NULL",
    "p3_grid": """
    WITH h AS (
        SELECT run_id, 'gpu_util_pct' AS metric, "timestamp" AS ts, recv_at, gpu_util_pct AS v FROM hardware WHERE "timestamp" IS NOT NULL
        UNION ALL SELECT run_id, 'ram_used_mb', "timestamp", recv_at, ram_used_mb FROM hardware WHERE "timestamp" IS NOT NULL),
    s AS (SELECT *, epoch(date_trunc('second', ts))::bigint // 10 AS s FROM h),
    b AS (SELECT run_id, metric, min(s) AS a, max(s) AS z FROM s GROUP BY run_id, metric),
    x AS (SELECT run_id, metric, s, v FROM s WHERE v IS NOT NULL AND NOT isnan(v) QUALIFY row_number() OVER (PARTITION BY run_id, metric, s ORDER BY ts DESC, recv_at DESC NULLS LAST, v DESC) = 1),
    g AS (SELECT run_id, metric, unnest(generate_series(a, z)) AS s FROM b),
    j AS (SELECT g.run_id, g.metric, g.s, x.v, x.s AS own FROM g LEFT JOIN x ON g.run_id IS NOT DISTINCT FROM x.run_id AND g.metric = x.metric AND g.s = x.s),
    n AS (SELECT *, last_value(own IGNORE NULLS) OVER p AS ps, last_value(v IGNORE NULLS) OVER p AS pv, first_value(own IGNORE NULLS) OVER f AS ns, first_value(v IGNORE NULLS) OVER f AS nv FROM j
        WINDOW p AS (PARTITION BY run_id, metric ORDER BY s ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY run_id, metric ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT run_id, metric, make_timestamp(s * 10000000) AS slot, round(CASE WHEN own IS NOT NULL THEN v WHEN ns - ps <= 7 THEN pv + (nv - pv) * (s - ps) / (ns - ps)::double END, 6) AS value,
        CASE WHEN own IS NOT NULL THEN 'observed' WHEN ns - ps <= 7 THEN 'interpolated' ELSE 'missing' END AS status FROM n""",
    "p3_found": f"""{_H}
        SELECT g.run_id, g.metric, strftime(make_timestamp(g.s * 10000000), '%Y-%m-%dT%H:%M:%S') AS slot
        FROM g LEFT JOIN x ON g.run_id IS NOT DISTINCT FROM x.run_id AND g.metric = x.metric AND g.s = x.s WHERE x.s IS NULL""",
}

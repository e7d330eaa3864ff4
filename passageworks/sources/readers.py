"""Readers and writers: passages, questions, telemetry and reports, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passageworks.functions.text import blank, not_available
from passageworks.operators.parsing import assemble_records, parse_passages, split_fields
from passageworks.operators.telemetry import METRICS, OPTIONAL

PASSAGE = "id string, text string, title string"
HEADER = "id\ttext\ttitle"
QA = "question string, short_answers string, long_answers string"


_TSV = {"sep": "\t", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "lineSep": "\n"}


def read_lines(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int = 1) -> DataFrame:
    """``file, block, line_no, line`` of text files, read in splits; ``line_no`` only orders the lines of a block.  A stream takes so many files at a time; its batches number their lines themselves."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger) if stream else spark.read
    lines = reader.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    return lines if stream else lines.withColumn("line_no", F.monotonically_increasing_id())


def read_records(spark: SparkSession, path: str, header: str | None = HEADER) -> DataFrame:
    """Records of tab-separated files, however large each is: ``file, block, line_no, raw, broken``.

    Quoted fields that span lines, also across splits, are put together by
    :func:`assemble_records`.  Records equal to ``header`` are left out.
    """
    records = assemble_records(read_lines(spark, path), ordered=True)
    return records if header is None else records.where(F.col("raw") != header)


def passages_of(lines: DataFrame, schema: str = PASSAGE) -> DataFrame:
    """Passages from lines: short rows have null fields, surplus fields are dropped, texts such as "null" stay."""
    fields = T.StructType.fromDDL(schema)
    lines = lines.withColumn("line_no", F.monotonically_increasing_id())
    records = assemble_records(lines, ordered=True).where(F.col("raw") != "\t".join(fields.names))
    return split_fields(records, fields.names).select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields])


def read_passages(spark: SparkSession, path: str, schema: str = PASSAGE) -> DataFrame:
    """Passages of tab-separated files with a header: quoted fields may span lines, quotes are doubled.

    Rows without text or with blank text are left out.  For the rows that
    fail, with their reasons, see :func:`load_passages`.
    """
    return passages_of(read_lines(spark, path), schema).where(~blank("text"))


def load_passages(spark: SparkSession, path: str, header: str | None = HEADER) -> DataFrame:
    """Every record of the files with its ``reason`` (null for a proper row), ``id``, ``text``, ``title``, or ``raw`` where it fails."""
    return parse_passages(read_records(spark, path, header), ["file", "block", "line_no"])


def write_passages(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_TSV, header=True, escapeQuotes=True, emptyValue="", nullValue="").csv(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """``query, gold_answer, all_answers`` of a question file; answers stay text, missing ones are null."""
    rows = spark.read.schema(QA).options(header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return load_questions(rows, "question", "short_answers", "long_answers")


def questions_of(spark: SparkSession, items: list[dict], name: str = "dataset") -> DataFrame:
    """``dataset, sample_id, query, gold_answer, all_answers`` of questions in memory: dicts with ``query`` and, if there are, ``gold_answer`` and ``all_answers``."""
    rows = [(name, i, x["query"], x.get("gold_answer"), list(x.get("all_answers") or ([x["gold_answer"]] if x.get("gold_answer") else []))) for i, x in enumerate(items)]
    return spark.createDataFrame(rows, "dataset string, sample_id long, query string, gold_answer string, all_answers array<string>")


def load_questions(df: DataFrame, question: str, short: str, long: str, *keep: str) -> DataFrame:
    """Questions with an answer: the short one if there is one, else the long one, and both as a list."""
    rows = df.select(*keep, F.col(question).alias("query"), not_available(short).alias("short"), not_available(long).alias("long")).dropna("all", subset=["short", "long"])
    return rows.select(*keep, "query", F.coalesce("short", "long").alias("gold_answer"), F.array_compact(F.array("short", "long")).alias("all_answers"))


def read_telemetry(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Samples by time; columns that a sampler left out at a row's end are null."""
    schema = ", ".join(["timestamp timestamp_ntz", *[f"{m} double" for m in [*METRICS, *OPTIONAL]]])
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).options(header=True, timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", mode="PERMISSIVE").csv(path)


def read_report_times(spark: SparkSession, path: str, pretty: bool = True) -> DataFrame:
    """Start and end of the pipeline in reports: one object a file, or one a line unless ``pretty``."""
    rows = spark.read.schema("pipeline string, pipeline_start string, pipeline_end string").option("multiLine", pretty).json(path)
    return rows.select("pipeline", F.col("pipeline_start").cast("timestamp_ntz").alias("start"), F.col("pipeline_end").cast("timestamp_ntz").alias("end"))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)

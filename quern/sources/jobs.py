"""Readers of job profiles and result logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of a job profile, in file order.
PROFILE_FIELDS = (
    ("map_tasks", "int"),
    ("red_tasks", "int"),
    ("deadline", "double"),
    ("join_time", "double"),
    ("priority", "double"),
    ("deadline_type", "int"),
    ("utility_type", "int"),
    ("sensitivity", "double"),
    ("job_class", "string"),
    ("job_name", "string"),
)
# Fields before the profile in a result line, in order, and the text before them.
RESULT_FIELDS = (
    ("exec_time", "double"),
    ("latency", "double"),
    ("utility_readable", "double"),
    ("utility", "double"),
    ("queue_id", "string"),
)
RESULT_MARK = "Job Complete Event: "
# Fixed value: name of a result log, a file or a folder of files, with policy and iteration.
RESULT_FILE = "(?:^|[/=])Result-([^/]+)-([0-9]+)\\.log(?:/[^/]+)?$"


def _fields(part: Column, fields: tuple, start: int = 0) -> list[Column]:
    return [part[start + i].cast(kind).alias(name) for i, (name, kind) in enumerate(fields)]


def job_profiles(lines: DataFrame, value: str = "value") -> DataFrame:
    """Ten fields between white space; a malformed line fails the query."""
    parts = lines.select(value, F.array_remove(F.split(value, "\\s+"), "").alias("p")).where(F.size("p") > 0)
    broken = F.raise_error(F.concat(F.lit("malformed job profile: "), F.col(value)))
    checked = F.when(F.size("p") == len(PROFILE_FIELDS), F.col("p")).otherwise(broken.cast("array<string>"))
    return parts.select(checked.alias("p")).select(*_fields(F.col("p"), PROFILE_FIELDS))


def job_profile_source(spark: SparkSession, path: str) -> DataFrame:
    return job_profiles(spark.read.text(path))


def result_lines(lines: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """The 15 fields of each ``... - Job Complete Event: ...`` line; other log lines are dropped."""
    part = F.split(F.substring_index(F.col(value), RESULT_MARK, -1), "\t")
    return (
        lines.where(F.contains(F.col(value), F.lit(RESULT_MARK)))
        .select(*keep, part.alias("p"))
        .select(*keep, *_fields(F.col("p"), RESULT_FIELDS), *_fields(F.col("p"), PROFILE_FIELDS, len(RESULT_FIELDS)))
    )


def result_log_source(spark: SparkSession, path: str) -> DataFrame:
    """Results of a folder of logs, with policy and iteration from the name of the file, or of the folder its files are in.

    Lines of files with other names have an empty policy and no iteration.
    """
    name = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
    lines = spark.read.text(path, recursiveFileLookup=True).select(
        "value",
        F.regexp_extract(name, RESULT_FILE, 1).alias("policy"),
        F.regexp_extract(name, RESULT_FILE, 2).try_cast("int").alias("iteration"),
    )
    return result_lines(lines, keep=("policy", "iteration"))

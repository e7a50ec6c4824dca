"""Writers; each replaces what an earlier run left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.jobs import PROFILE_FIELDS

# Columns of the result file in order.
RESULT_COLUMNS = (
    "exec_time",
    "latency",
    "utility",
    "map_tasks",
    "red_tasks",
    "deadline",
    "join_time",
    "priority",
    "deadline_type",
    "job_class",
)


def kv_text_sink(df: DataFrame, path: str, key: tuple[str, ...], value: tuple[str, ...], key_separator: str = "|") -> None:
    """``key<TAB>value`` lines; several key or value columns are joined."""
    left = F.concat_ws(key_separator, *[F.col(c).cast("string") for c in key])
    right = F.concat_ws(" ", *[F.col(c).cast("string") for c in value])
    df.select(F.concat_ws("\t", left, right).alias("value")).write.mode("overwrite").text(path)


def tera_sink(records: DataFrame, path: str) -> None:
    """Key and value side by side, lines ended by CR LF."""
    records.select(F.concat("key", "value").alias("value")).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def _tab_sink(df: DataFrame, columns: tuple[str, ...], path: str) -> None:
    df.select(*columns).write.mode("overwrite").option("sep", "\t").option("lineSep", "\n").csv(path)


def job_result_sink(results: DataFrame, path: str) -> None:
    """One tab-separated line per finished job; the class goes without its package."""
    short = results.withColumn("job_class", F.substring_index("job_class", ".", -1))
    _tab_sink(short, RESULT_COLUMNS, path)


def result_log_sink(lines: DataFrame, path: str, policy: str = "policy", iteration: str = "iteration", value: str = "value") -> None:
    """Log lines in one folder per policy and iteration, under the name ``result_log_source`` reads both from."""
    name = F.concat(F.lit("Result-"), F.col(policy), F.lit("-"), F.col(iteration).cast("string"), F.lit(".log"))
    lines.select(name.alias("log"), F.col(value).alias("value")).write.mode("overwrite").partitionBy("log").text(path)


def job_profile_sink(profiles: DataFrame, path: str) -> None:
    _tab_sink(profiles, tuple(name for name, _ in PROFILE_FIELDS), path)


def model_sink(model: DataFrame, path: str) -> None:
    """``k<TAB>similarity movie total reviews``, the layout ``centroid_source`` reads.

    A line per block; those after a centroid's first have their start before the reviews.
    """
    placed = model.withColumn("list", F.when(F.col("start") > 0, F.concat_ws(" ", "start", "reviews")).otherwise(F.col("reviews")))
    kv_text_sink(placed, path, ("k",), ("similarity", "movie_id", "total", "list"))

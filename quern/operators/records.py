"""Sort records: generation, total-order sort, split points and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.numeric import uniform
from quern.functions.records import filler, padded_id, with_key
from quern.operators.ordering import pick_split_points, previous_values, row_rank, with_bucket

# Rows of a generated table by default, and keys sampled for split points.
DEFAULT_ROWS = 3_000_000
SAMPLE_ROWS = 100_000


def row_range(spark: SparkSession, rows: int = DEFAULT_ROWS, parts: int | None = None) -> DataFrame:
    """Consecutive row ids from 0."""
    return spark.range(0, rows, 1, parts).withColumnRenamed("id", "row_id")


def teragen(rows: DataFrame, row_id: str = "row_id") -> DataFrame:
    """The record of each row id: a ten-character key and a value of padded id and filler."""
    keyed = with_key(rows.select(F.col(row_id).cast("bigint").alias("_row")), "_row")
    return keyed.selectExpr("key", f"concat({padded_id('_row')}, {filler('_row')}) as value")


def terasort(records: DataFrame, parts: int | None = None, key: str = "key", ties: tuple[str, ...] = ("value",)) -> DataFrame:
    """Rows in total order of the key over ``parts`` partitions, as many as a shuffle has unless given.

    The ranges run over the key and then ``ties``, so a hot key is spread over partitions too.
    Name a row id among the ties if whole rows repeat often.
    """
    parts = parts or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return records.repartitionByRange(parts, key, *ties).sortWithinPartitions(key, *ties)


def sorted_places(
    records: DataFrame, key: str = "key", ties: tuple[str, ...] = ("value",), ranges: int | None = None
) -> DataFrame:
    """Add each record's 1-based place in the total order."""
    return row_rank(records, "place", [], [key, *ties], ranges)


def range_split_points(
    records: DataFrame, parts: int, key: str = "key", identity: tuple[str, ...] = ("value",), sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """The ``parts - 1`` evenly spaced keys of a sample of about ``sample_rows`` records.

    A record is sampled by a hash of its identity, so the same records give the same points.
    """
    share = sample_rows / max(records.count(), 1)
    row_text = F.concat_ws("|", *[F.col(c).cast("string") for c in identity])
    sample = records if share >= 1 else records.where(uniform(row_text, "split") < share)
    return pick_split_points(sample, [key], parts)


def range_partition(records: DataFrame, splits: list[str], key: str = "key", name: str = "part") -> DataFrame:
    """Add the index of the first split point at or above the key."""
    return with_bucket(records, [key], [(s,) for s in splits], name)


def teravalidate(
    records: DataFrame, file: str = "file", order: tuple[str, ...] = ("pos",), key: str = "key", ranges: int | None = None
) -> DataFrame:
    """A row for every misordered neighbour inside a file and every misordered file end.

    No row means sorted; equal keys are in order.  File ends are compared in order of their
    names ``file:begin`` and ``file:end``.
    """
    rows = records.select(F.col(file).alias("file"), *order, F.col(key).alias("key"))
    near = previous_values(rows, {"last": "key"}, ["file"], list(order), ranges)
    inside = near.where(F.col("key") < F.col("last")).select(
        F.format_string("misorder in %s last: '%s' current: '%s'", "file", "last", "key").alias("error")
    )
    place = F.struct(*order)
    ends = rows.groupBy("file").agg(F.min_by("key", place).alias("begin"), F.max_by("key", place).alias("end"))
    named = F.array(*[F.struct(F.concat("file", F.lit(f":{e}")).alias("end_name"), F.col(e).alias("key")) for e in ("begin", "end")])
    entries = ends.select(F.explode(named).alias("e")).select("e.*")
    chain = previous_values(entries, {"last_name": "end_name", "last": "key"}, [], ["end_name"], ranges)
    between = chain.where(F.col("key") < F.col("last")).select(
        F.format_string("misordered keys last: %s '%s' current: %s '%s'", "last_name", "last", "end_name", "key").alias("error")
    )
    return inside.unionByName(between)

"""Running totals, ranks and neighbours in order, for groups of any size.

A window over a group runs it in one task.  Here the rows are cut into ranges of the whole sort order at sampled
split points, each range of a group is worked on by itself, and what earlier ranges carry over comes from one small row per
group and range.  There is this one way for tables of any size.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows sampled per range.
SAMPLE_ROWS = 20


def pick_split_points(sample: DataFrame, columns: list[str], parts: int) -> DataFrame:
    """The ``parts - 1`` evenly spaced rows of a sample in sort order, with their number from 1.

    The sample is bounded by its maker, so it is ranked in one task.
    """
    if parts < 2:
        return sample.select(F.lit(1).alias("split"), *columns).where(F.lit(False))
    ranked = sample.select(
        F.row_number().over(Window.orderBy(*columns)).alias("_at"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("_n"),
        *columns,
    )
    # Split i is the row at 0-based place round(i * n / parts); a row finds its i from its place.
    step = F.col("_n") / F.lit(float(parts))
    nearest = F.floor((F.col("_at") - 1) / step + 0.5)
    candidates = F.array(*[nearest + d for d in (-1, 0, 1)])
    return (
        ranked.select(F.explode(candidates).alias("split"), "_at", step.alias("_step"), *columns)
        .where(F.col("split").between(1, parts - 1))
        .where(F.floor(F.col("split") * F.col("_step") + 0.5) == F.col("_at") - 1)
        .select(F.col("split").cast("int").alias("split"), *columns)
    )


def split_points(df: DataFrame, columns: list[str], ranges: int) -> list[tuple]:
    """Split points between ranges as texts of their columns; ``ranges - 1`` of them reach the driver.

    The sample is the rows with the smallest hashes, so one pass finds it and the same rows give the same points.
    """
    if ranges < 2:
        return []
    sample = df.select(*columns).orderBy(F.xxhash64(*columns), *columns).limit(SAMPLE_ROWS * ranges)
    texts = [F.col(c).cast("string") for c in columns]
    return [tuple(row) for row in pick_split_points(sample, columns, ranges).orderBy("split").select(*texts).collect()]


def bucket_of(df: DataFrame, columns: list[str], splits: list[tuple]) -> Column:
    """Number of split points below the row, so a row equal to a split goes to the lower side.

    A binary search over a constant array: the array is padded to a power of two with nulls,
    which no row is above.  The split points are given as texts and cast to the columns' types.
    """
    if not splits:
        return F.lit(0)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    size = 1
    while size <= len(splits):
        size *= 2
    rows = [dict(zip(columns, s)) for s in splits] + [None] * (size - len(splits))
    as_text = ",".join(f"`{c}`:string" for c in columns)
    as_typed = ",".join(f"`{c}`:{types[c]}" for c in columns)
    parsed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{as_text}>>")
    points = parsed.cast(f"array<struct<{as_typed}>>")
    row = F.struct(*[F.col(c) for c in columns])
    steps = [size >> i for i in range(1, size.bit_length())]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: at + F.when(points[at + s - 1] < row, s).otherwise(0),
    )


def with_bucket(df: DataFrame, columns: list[str], splits: list[tuple], name: str) -> DataFrame:
    """Add ``bucket_of`` as a column.

    It is added by a generator of one row, as a plain column would let the optimizer move the
    expressions that make ``columns`` into the search, to be worked out again at every step.
    """
    return df.select("*", F.explode(F.array(bucket_of(df, columns, splits))).alias(name))


@dataclass(frozen=True)
class Ordered:
    """Rows whose groups are in order; made by ``in_order``, and read by ``rows``.

    Rows carry ``_group`` (one null-safe key of the group) and ``_bucket`` (their range of
    the whole sort order), and each step works on them as they are.
    """

    frame: DataFrame
    order: list[str]

    def rows(self) -> DataFrame:
        return self.frame.drop("_group", "_bucket")

    def total(self, value: Column, name: str) -> Ordered:
        """Add the sum of ``value`` over the rows of the group up to and including this one."""
        valued = self.frame.withColumn("_value", value)
        before = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = (
            valued.groupBy("_group", "_bucket")
            .agg(F.sum("_value").alias("_sum"))
            .select("_group", "_bucket", F.sum("_sum").over(before).alias("_carried"))
        )
        to_here = (Window.unboundedPreceding, Window.currentRow)
        inside = Window.partitionBy("_group", "_bucket").orderBy(*self.order).rowsBetween(*to_here)
        joined = valued.withColumn(name, F.sum("_value").over(inside)).join(carried, ["_group", "_bucket"])
        both = F.coalesce(F.col(name) + F.col("_carried"), F.col(name), F.col("_carried"))
        return replace(self, frame=joined.withColumn(name, both).drop("_value", "_carried"))

    def rank(self, name: str) -> Ordered:
        """Add the 1-based place of the row in its group."""
        return self.total(F.lit(1).cast("bigint"), name)

    def previous(self, values: dict[str, str]) -> Ordered:
        """Add, for each ``name: column``, the column's value in the row before; null in the first row."""
        here = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
        held = self.frame.withColumn("_here", here)
        place = F.struct(*[F.col(c) for c in self.order])
        last = held.groupBy("_group", "_bucket").agg(F.max_by("_here", place).alias("_last"))
        buckets = Window.partitionBy("_group").orderBy("_bucket")
        carried = last.select("_group", "_bucket", F.lag("_last").over(buckets).alias("_carried"))
        inside = Window.partitionBy("_group", "_bucket").orderBy(*self.order)
        joined = held.withColumn("_before", F.lag("_here").over(inside)).join(carried, ["_group", "_bucket"])
        ready = joined.withColumn("_before", F.coalesce("_before", "_carried")).drop("_here", "_carried")
        for name in values:
            ready = ready.withColumn(name, F.col("_before")[name])
        return replace(self, frame=ready.drop("_before"))


def in_order(df: DataFrame, partition: list[str], order: list[str], ranges: int | None = None) -> Ordered:
    """Prepare rows for steps in order: ``order`` columns sort upwards and should leave no ties.

    The rows are sampled here, in one job, and read again for the result, so give a scan or a written table
    rather than a costly plan.  There are as many ranges as a shuffle has partitions unless ``ranges`` is given.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = partition + order
    splits = split_points(df, columns, ranges)
    group = F.struct(*[F.col(c) for c in partition]) if partition else F.lit(0)
    return Ordered(with_bucket(df, columns, splits, "_bucket").withColumn("_group", group), order)


def running_total(
    df: DataFrame, value: Column, name: str, partition: list[str], order: list[str], ranges: int | None = None
) -> DataFrame:
    return in_order(df, partition, order, ranges).total(value, name).rows()


def row_rank(df: DataFrame, name: str, partition: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    return in_order(df, partition, order, ranges).rank(name).rows()


def previous_values(
    df: DataFrame, values: dict[str, str], partition: list[str], order: list[str], ranges: int | None = None
) -> DataFrame:
    return in_order(df, partition, order, ranges).previous(values).rows()

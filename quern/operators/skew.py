"""Guards against groups that hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A side is broadcast only up to this many rows and bytes, counted before the hint is given.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def _width(df: DataFrame) -> Column:
    """Bytes of a row: eight for each column, and those of its text; columns of other kinds count as JSON."""
    width = F.lit(8 * len(df.columns))
    for field in df.schema.fields:
        kind, column = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(column), F.lit(0))
        elif kind in ("array", "struct", "map", "variant"):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return width.cast("bigint")


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the frame has at most ``max_rows`` rows of ``max_bytes`` together, else leave the join to shuffle."""
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(_width(df))).first()
    if rows <= max_rows and (size or 0) <= max_bytes:
        return F.broadcast(df)
    return df


def group_key(columns: list[str]) -> Column:
    """One column that stands for the group and is equal for equal nulls too."""
    return F.struct(*[F.col(c) for c in columns])


def join_totals(df: DataFrame, columns: list[str], *aggregates: Column) -> DataFrame:
    """Add per-group aggregates to every row.

    The aggregates are combined before the shuffle and come back by a join; a window would put a
    hot group into one task.  Up to ``BROADCAST_ROWS`` groups the rows themselves are not shuffled
    at all; the price is that the groups are counted first.  Beyond, adaptive execution splits hot
    groups of the join.
    """
    keyed = df.withColumn("_group", group_key(columns))
    totals = keyed.groupBy("_group").agg(*aggregates)
    return keyed.join(checked_broadcast(totals), "_group").drop("_group")


def block_of(member: Column, blocks: Column) -> Column:
    """The block of a member of a group, from the first 60 bits of its MD5, so that other engines give the same."""
    number = F.conv(F.substring(F.md5(member.cast("string")), 1, 15), 16, 10).cast("bigint")
    return F.pmod(number, blocks.cast("bigint")).cast("int")


def with_blocks(df: DataFrame, columns: list[str], member: Column, block_rows: int) -> DataFrame:
    """Add ``_block`` and ``_blocks``: a group of n rows is split into ceil(n / block_rows) blocks by a hash of ``member``.

    The number of blocks follows from the group alone, whatever the size of the table, and the block from the row
    alone, so a task that runs again puts each row where it was.  The sizes are hashed, one row per group of several
    blocks, so the rows are not sorted.
    """
    blocks = F.ceil(F.count(F.lit(1)) / block_rows).cast("int")
    names = [f"_group_{i}" for i in range(len(columns))]
    sizes = df.groupBy(*[F.col(c).alias(n) for c, n in zip(columns, names)]).agg(blocks.alias("_blocks")).where(F.col("_blocks") > 1)
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(columns, names)]
    joined = df.join(sizes.hint("shuffle_hash"), same, "left").drop(*names)
    number = F.coalesce("_blocks", F.lit(1))
    block = F.when(number > 1, block_of(member, number)).otherwise(0)
    return joined.withColumn("_block", block).withColumn("_blocks", number)

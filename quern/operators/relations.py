"""Candidate itemsets by self-join, and adjacency lists of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.skew import with_blocks

# Items of one prefix that meet in one task; a prefix with more is split into blocks.
BLOCK_ROWS = 5_000
# Neighbours of a node and side in one row of the adjacency list.
LIST_ROWS = 100_000


def self_join(itemsets: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(prefix, item_a, item_b) for each pair item_a < item_b of distinct items of one prefix.

    The pairs of a prefix are the result itself.  A prefix with many items is split into blocks
    by a hash of the item, and two blocks meet in a cell of their own: every pair is made once,
    in the one cell of its two blocks, and no task holds more than two blocks of a prefix.
    """
    items = itemsets.select("prefix", "item").distinct()
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    cells = (
        with_blocks(items, ["prefix"], F.col("item"), block_rows)
        .select("prefix", "item", "_block", other.alias("_other"))
        .withColumn("_low", F.least("_block", "_other"))
        .withColumn("_high", F.greatest("_block", "_other"))
    )
    a, b = cells.alias("a"), cells.alias("b")
    same_cell = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("prefix", "_low", "_high")]
    apart = (F.col("a._block") != F.col("b._block")) | (F.col("a._low") == F.col("a._high"))
    pairs = a.join(b, [*same_cell, F.col("a.item") < F.col("b.item"), apart])
    return pairs.select(
        F.col("a.prefix").alias("prefix"), F.col("a.item").alias("item_a"), F.col("b.item").alias("item_b")
    )


def adj_list(edges: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """(node, side, block) -> sorted distinct neighbours; ``from`` are those before the node, ``to`` those after it.

    A side of n neighbours has ceil(n / list_rows) blocks, numbered from 0, that together hold each of them once, so
    a node with a large share of all edges is never brought together.  A side without neighbours has no row.
    """
    side = F.explode(
        F.array(
            F.struct(F.col("dst").alias("node"), F.lit("from").alias("side"), F.col("src").alias("other")),
            F.struct(F.col("src").alias("node"), F.lit("to").alias("side"), F.col("dst").alias("other")),
        )
    )
    ends = edges.select("src", "dst").distinct().select(side.alias("e")).select("e.*")
    blocks = with_blocks(ends, ["node", "side"], F.col("other"), list_rows)
    return blocks.groupBy("node", "side", F.col("_block").alias("block")).agg(
        F.array_sort(F.collect_list("other")).alias("neighbours")
    )


def packed_adjacency(adjacency: DataFrame) -> DataFrame:
    """(node, block, ``from{a,b}:to{c}``): a line per node, more for nodes of several blocks."""
    lists = {s: F.concat_ws(",", F.max(F.when(F.col("side") == s, F.col("neighbours")))) for s in ("from", "to")}
    text = F.format_string("from{%s}:to{%s}", lists["from"], lists["to"])
    return adjacency.groupBy("node", "block").agg(text.alias("adjacency"))

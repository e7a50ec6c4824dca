"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v); a component is named by its smallest node.

    Each round lets every node move to its smallest neighbour and joins nodes that met, so the graph shrinks
    until no edge is left.  Rounds are written to the shared folder; only whether edges are left reaches the driver.
    """
    moves = []
    edges = edges.where("u <> v").select("u", "v")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    while True:
        both = edges.union(edges.select("v", "u"))
        move = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to"))
        moves.append(written(move, "moves"))
        left, right = (moves[-1].select(F.col("u").alias(c), F.col("to").alias(f"{c}_to")) for c in ("u", "v"))
        edges = written(
            edges.join(left, "u").join(right, "v")
            .select(F.least("u_to", "v_to").alias("u"), F.greatest("u_to", "v_to").alias("v"))
            .where("u <> v")
            .distinct(),
            "edges",
        )
        if edges.isEmpty():
            break
    found = nodes.withColumn("component", F.col("node"))
    for move in moves:
        found = found.join(move.withColumnRenamed("u", "component"), "component", "left").select(
            "node", F.coalesce("to", "component").alias("component")
        )
    return found

"""Connected components of a graph of 64-bit node keys, by contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of an edge ``a``, ``b``; the root is one node of its component.

    Each round lets every node point at the least of itself and its neighbours and merges along the
    pointers.  Keys are hashes, so a round removes a constant share of the nodes whatever the shape,
    and the number of rounds grows with the logarithm.  Tables are written between rounds; nothing is
    gathered in the driver.  Null keys and loops are ignored; an empty table has no components.
    """
    edges = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    rounds = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")),
                      "step")
        rounds.append(step)
        left = edges.join(step.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
        edges = stored(left.join(step.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
                       .filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[-1]
    for step in reversed(rounds[:-1]):
        above = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = step.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return out

"""Connected components of an edge table, for graphs of any size.

Alternating star contraction: a large-star step links every larger neighbour of a
node to the smallest neighbour, a small-star step links the smaller ones, until
no edge changes. Each step is an aggregation and a join, whose hot keys Spark can
split; edges never leave the executors. After every round the edges are stored
with ``checkpoint()`` in the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepguard.session import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over directed rows (u, v)."""
    if large:
        rows = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    else:
        rows = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = rows.join(least, "u")
    if large:
        linked = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return linked.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of an edge.

    ``edges`` has two columns of one orderable type. Self-links give a component
    of their own only through other edges; an empty table gives no rows.
    """
    names = edges.columns
    current = checkpointed(
        edges.select(F.col(names[0]).alias("u"), F.col(names[1]).alias("v"))
        .filter(F.col("u") != F.col("v"))
        .distinct()
    )
    state = None
    while True:
        current = checkpointed(_star(_star(current, True), False))
        # the same sums over two rounds: the star forest no longer changes
        seen = tuple(
            current.agg(
                F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
            ).first()
        )
        if seen == state:
            break
        state = seen
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.union(roots)

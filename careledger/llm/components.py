"""Connected components of an edge list by alternating star contractions.

Each round hooks the larger neighbours of every node, then the smaller ones, to the
smallest in sight; the edges end as stars around the smallest node of a component.
The number of rounds grows with the logarithm of the longest path. Minima are combined
per task before a shuffle, so a hub with very many neighbours is no hot group, and the
joins on a hub can be split. Only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careledger.llm.shared import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        both.join(least, "a")
        .filter(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    # Every edge has its larger end in ``a``.
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hooked = edges.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hooked.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).union(
        least.select("a", F.col("m").alias("b"))
    ).distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node with an edge to another node.

    The component is its smallest node. Edges have no direction and may repeat; loops
    and edges with a null end are left out.
    """
    a, b = F.col(left), F.col(right)
    state = edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    seen = None
    while True:
        state = cut(_small_star(_large_star(state)), "stars")
        # A wrapping sum: equal edge sets have equal sums, whatever their order.
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = state.select(F.col("b").alias("node")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )

"""Connected components by alternating large-star and small-star rounds, each a join and an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


#: Edges whose least neighbours may be broadcast (two longs a row); edges of a partition that a round writes.
MOST_BROADCAST, PER_PARTITION = 500_000, 250_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of edges (a, b), the smallest node that it reaches. A stored table.

    Loops, repeated edges and both directions may occur; nodes without an edge to another aren't returned. Each round
    keeps at most one row a node and edge, so a hub costs no more than its edges.
    """
    e = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, last = stored(e, "edges"), None
    while (mark := _mark(e)) != last and mark[0]:
        last = mark
        parts = max(8, mark[0] // PER_PARTITION)
        hint = F.broadcast if mark[0] <= MOST_BROADCAST else lambda df: df
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = hint(both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(least, F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.coalesce(parts), "edges")  # a row per edge at most
        least = hint(large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")))
        small = large.join(least, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        e = stored(small.filter("u > v").distinct().coalesce(parts), "edges")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(nodes.select(F.col("component").alias("node"), "component").distinct())

"""Connected components of an edge list by alternating large and small stars.

Each round is two aggregations over the edges, so no component is ever held in
one task, and every round's edges are written out before the next.  Self loops,
repeated edges and both directions may be given; the result has each node that
occurs in an edge with the smallest node it reaches.  No edges: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every node's neighbours to the smallest of them: the larger ones, or the smaller."""
    if large:
        seen = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = seen.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        seen = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = seen.groupBy("a").agg(F.min("b").alias("m"))
        linked = seen.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        linked = linked.unionAll(least.select("a", F.col("m").alias("b")))
    return linked.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` from edges ``a, b`` of longs."""
    edges = cut(edges.select("a", "b").filter("a != b").distinct(), "edges")
    size = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    state = edges.agg(size.alias("s")).head().s
    while True:
        edges = cut(_star(cut(_star(edges, True), "large"), False), "small")
        now = edges.agg(size.alias("s")).head().s
        if now == state:
            break
        state = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return stars.unionAll(roots).distinct()

"""Connected components by alternating large-star and small-star rounds, all on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import cut, release


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for each node on an edge. edges: a, b, of one orderable type.

    A node's neighbours are never gathered: each round takes a minimum per node and joins it back. The
    rounds, some log2 of the nodes squared at most, end when the edges stop changing: then each edge joins a
    node to its root.
    """
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    now = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a != b).distinct())
    state, after = None, _state(now)
    while after[0] and after != state:
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least(a, m).alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), m.alias("b")).where(a != b).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        before, now = now, cut(small.select(b.alias("a"), m.alias("b")).unionByName(least.select("a", m.alias("b"))).where(a != b).distinct())
        release(before)
        state, after = after, _state(now)
    return now.select(a.alias("node"), b.alias("root")).unionByName(now.select(b.alias("node"), b.alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    """The number of edges and a sum of their hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

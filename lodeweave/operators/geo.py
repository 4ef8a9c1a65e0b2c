"""Neighbourhoods of geo cells over a table of edges; cells are opaque keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def k_ring(cells: DataFrame, edges: DataFrame, k: int = 1) -> DataFrame:
    """The cells and all within k steps of them, once each. cells: cell; edges: src, dst, both directions."""
    found, edges = cells.select("cell").distinct(), edges.select(F.col("src").alias("cell"), F.col("dst").alias("_next"))
    for _ in range(k):
        near = found.join(edges, "cell").select(F.col("_next").alias("cell"))
        found = found.union(near).distinct()
    return found


def restrict(cells: DataFrame, universe: DataFrame) -> DataFrame:
    """The cells that are in the universe, once each."""
    return cells.select("cell").distinct().join(universe.select("cell"), "cell", "left_semi")

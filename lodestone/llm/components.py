"""Connected components of an edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_unique, reading, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node's larger neighbours are tied to its least neighbour."""
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    tied = join_unique(both.where("b > a"), least.select("a", "m"), ["a"], least, "n", 2 * total)
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    tied = join_unique(down, least.select("a", "m"), ["a"], least, "n", total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node
    of ``edges`` (a long, b long; any direction, repeats allowed).

    Each round's edges are written to the shared folder, which cuts the
    lineage, and go when the next ones stand; the rounds end when every tree is a star.  They grow with the
    logarithm of the longest path.  A hub of very many edges is joined by a
    broadcast (see ``join_unique``).
    """
    edges = written(edges.where("a <> b").select("a", "b").distinct())
    for _ in range(rounds):
        for star in (_large_star, _small_star):
            before, edges = edges, written(star(edges, edges.count()))
            discard(before)
        # stars: no root is itself tied to another node, and no node has two roots
        loose = edges.select(F.col("b").alias("a")).distinct().join(edges.select("a").distinct(), "a", "left_semi")
        if loose.isEmpty() and edges.groupBy("a").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"no stars after {rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return reading(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), edges)

"""Connected components of a graph given as links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_saved, saved

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """node, root of each node that has a link; ``links`` has columns a, b and ``root`` is the smallest node reachable.

    A round hangs every larger neighbour of a node onto the smallest of its neighbourhood (large star), then
    every smaller one (small star). Each step is a minimum per node, combined before the shuffle, and a join
    back on the node, which Spark may split where a node has many links; no neighbourhood is ever gathered.
    Rounds are about the logarithm of the longest path. Self-links and repeated links are fine; no links give no rows.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        new = saved(_small_star(_large_star(edges)))
        drop_saved(edges)
        edges, old = new, state
        if (state := _state(edges)) == old:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    if state[0]:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple[int, int | None]:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges are (u, v) with v < u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()

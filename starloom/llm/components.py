"""Connected components by alternating large-star and small-star.

Edges stay in Spark; every round is written to the shared folder, so lineage
stays short and a lost executor costs one round at most.  The minima are
pre-aggregated before they are exchanged, and they meet the edges in plain
equi-joins, which adaptive execution splits at hub nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, component) of every node that stands in a link (a, b); component is the least node reachable."""
    start = links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct()
    edges = scratch.write(start, f"{tag}-0")
    state, k = _state(edges), 0
    while state[0]:
        k += 1
        half = scratch.write(_large_star(edges), f"{tag}-{k}l")
        edges = scratch.write(_small_star(half), f"{tag}-{k}")
        scratch.drop(f"{tag}-{k}l")
        scratch.drop(f"{tag}-{k - 1}")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))

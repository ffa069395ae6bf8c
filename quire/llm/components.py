"""Connected components of a graph given by its edges, in rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialize


def _joined(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with the least neighbour of u. Both sides are read from files, so that Spark shuffles
    both for the join and can split a hub's edges over tasks."""
    return edges.join(least, "u")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the least node reachable.

    Each round links every node's larger neighbours to its least one, then its smaller ones; the
    graph has become stars around the least nodes when a round changes nothing. Nodes without
    edges don't appear; self-loops, repeated and null edges are ignored."""
    now = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, "edges")
    before = _state(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = _joined(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        discard(now, least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = _joined(large, least).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.union(least.select("u", F.col("m").alias("v")))
        now = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small")
        discard(large, least)
        after = _state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

"""Undirected components by alternating large-star and small-star steps until nothing changes.

Every step is a grouped minimum and a join back on the node; nothing is collected but three numbers a round, and each
round's edges are kept by the caller's means, so lineage stays short. The number of rounds grows with the logarithm
of the longest path, not with the size of a component.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileflow.operators.graph import Graph
from tileflow.plans.lineage import cut, drop


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def stars(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut, remove: Callable[[DataFrame], None] = drop) -> DataFrame:
    """(node, component) for each node of edges (u long, v long) that isn't its component's smallest; component is that smallest.

    Self-loops, repeated and reversed edges do no harm; without edges the result is empty. keep: computes a table and
    ends its lineage; remove: lets go of such a table.
    """
    now = keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = keep(small)
        before, state = state, _state(after)
        remove(now)
        now = after
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def components(graph: Graph) -> DataFrame:
    """id, label: the smallest id of each vertex's undirected component."""
    found = stars(graph.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return graph.vertices.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("label"))

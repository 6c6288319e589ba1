"""Connected components of an undirected graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm._shared import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """The component of every node of ``edges(a, b)``: (node, root), where root
    is the smallest node reachable.

    Alternates large stars (each node links its larger neighbours to the least
    one around) and small stars (its smaller ones) until nothing changes: the
    edges are then stars around the roots.  The number of rounds grows with the
    logarithm of the number of nodes.  Least neighbours are partial aggregates,
    and go through the shared folder so that the joins that follow read both
    sides from an exchange, where a hub's rows can be split.  Self-loops and
    null ends are left out; no edges give no rows.
    """
    edges = edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, f"{name}-edges")
    before = _state(edges)
    while before[0]:
        # Large star: every neighbour v > u of u is linked to the least of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-least")
        linked = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        linked = materialize(linked, f"{name}-large")
        # Small star: u and its smaller neighbours are linked to the least of those.
        least = materialize(linked.groupBy("a").agg(F.min("b").alias("m")), f"{name}-least")
        pairs = linked.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(pairs.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), f"{name}-small")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)

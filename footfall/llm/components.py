"""Connected components of a graph too large for one machine, by alternating stars.

In a large star each node hangs its larger neighbours on its smallest one, in a small star it hangs
its smaller neighbours (and itself) there. Repeated, all nodes of a component end up hanging on its
smallest node, after a number of rounds that grows with the logarithm of its longest path. Only the
edges are stored between rounds. A node that most edges meet at is a hot join key: both sides of the
join are shuffled anew, so that adaptive execution can split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from footfall.llm.common import cut, new_key


def _hang(edges: DataFrame, larger: bool) -> DataFrame:
    """Edges (a, b) grouped by a, which is joined to each b; the result points from larger to smaller."""
    least = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    least = least.select(new_key(F.col("a")).alias("k"), "m")
    # With small stars the node itself hangs on the smallest as well.
    rows = edges.where("b > a") if larger else edges.union(edges.select("a", F.col("a").alias("b")))
    return (
        rows.select(new_key(F.col("a")).alias("k"), "b")
        .join(least, "k")
        .where("b <> m")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for all nodes but the roots themselves.

    ``edges`` has two bigint columns ``a`` and ``b`` without nulls, in either direction; loops and
    repeated edges do no harm. Without edges the result is empty.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = cut(_hang(_hang(both, larger=True), larger=False))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

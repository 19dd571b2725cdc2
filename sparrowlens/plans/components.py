"""Connected components as rounds of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for undirected ``edges(a, b)``; component = smallest node id.

    Alternates large-star and small-star rewrites, so the number of rounds grows with
    the logarithm of the number of nodes and a hub never multiplies its edges: each
    rewrite keeps at most one edge per existing edge. Links stay in Spark; only their
    number reaches the driver. Self loops and duplicates are allowed, nulls are dropped.
    Rounds end when number and exclusive-or of the hashes of all edges stay the same.
    """
    e = staged(edges.where("a is not null and b is not null").select(F.col("a"), F.col("b")))
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    e = staged(_canonical(e))
    before = None
    for _ in range(rounds):
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before, e = now, staged(_star(_star(e, large=True), large=False))
    else:
        raise RuntimeError("connected components did not settle")
    return nodes.join(e.select(F.col("a").alias("node"), F.col("b").alias("low")), "node", "left").select("node", F.coalesce("low", "node").alias("component"))


def tree_roots(parents: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every ``a`` in ``parents(a, b)``: the root above it.

    Each ``a`` has one parent ``b``, and there are no cycles. Every round doubles the
    length of the way that a node looks up, so there are as many rounds as the logarithm
    of the height.
    """
    p = staged(parents.select("a", "b"))
    for _ in range(rounds):
        up = p.select(F.col("a").alias("b"), F.col("b").alias("next"))
        p = staged(p.join(up, "b", "left").select("a", F.coalesce("next", "b").alias("b"), F.col("next").isNotNull().alias("moved")))
        if p.where("moved").isEmpty():
            return p.select(F.col("a").alias("node"), F.col("b").alias("component"))
    raise RuntimeError("the parents hold a cycle")


def _canonical(e: DataFrame) -> DataFrame:
    return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(e: DataFrame, *, large: bool) -> DataFrame:
    """One star rewrite: link neighbours of each node to the least id around it."""
    if large:
        both = e.union(e.select(F.col("b"), F.col("a")))
        w = Window.partitionBy("a")
        low = both.withColumn("m", F.least(F.min("b").over(w), F.col("a")))
        out = low.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        w = Window.partitionBy("a")
        low = e.withColumn("m", F.min("b").over(w))
        out = low.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()

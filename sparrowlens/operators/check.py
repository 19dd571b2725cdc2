"""Checks between two implementations of one result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine_or


def cosines(a: DataFrame, b: DataFrame, key: str, vec: str = "vec", degenerate: float = 1.0) -> DataFrame:
    """``(key, cosine)`` of vectors with one key; ``degenerate`` where either is zero."""
    j = a.select(key, F.col(vec).alias("_a")).join(b.select(key, F.col(vec).alias("_b")), key)
    return j.select(key, cosine_or(F.col("_a"), F.col("_b"), degenerate).alias("cosine"))


def compare_vectors(a: DataFrame, b: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """``(rows, min_cosine, mean_cosine, max_cosine)`` of vectors with one key; 1 for none."""
    c = cosines(a, b, key, vec).select(F.col("cosine").alias("c"))
    one = F.lit(1.0)
    return c.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.min("c"), one).alias("min_cosine"), F.coalesce(F.avg("c"), one).alias("mean_cosine"), F.coalesce(F.max("c"), one).alias("max_cosine"))


def compare_hits(a: DataFrame, b: DataFrame, key: str, query: str = "query_id") -> DataFrame:
    """``(query, overlap, max_delta)``: share of the hits of ``a`` that ``b`` has, and their largest score gap."""
    other = b.select(query, key, F.col("score").alias("_s"))
    j = a.join(other, [query, key], "left")
    return j.groupBy(query).agg((F.count("_s") / F.count(F.lit(1))).alias("overlap"), F.coalesce(F.max(F.abs(F.col("score") - F.col("_s"))), F.lit(0.0)).alias("max_delta"))

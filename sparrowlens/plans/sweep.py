"""Timing of index build, query and search over corpora of growing size."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import resample, with_ordinal
from ..operators.pooling import _pool_joined, pool
from ..operators.search import search_one
from .staging import staged

SCHEMA = "corpus_size long, embed_ms double, joined_embed_ms double, search_ms double, total_ms double, joined_total_ms double, speedup double"


def speedup(slow: float, fast: float) -> float:
    return slow / fast if fast > 0 else 0.0


def _timed(df: DataFrame) -> float:
    """Milliseconds to make every column of every row."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return (time.perf_counter() - began) * 1000


def sweep(chunks: DataFrame, emb: DataFrame, dim: int, query: np.ndarray, sizes: Iterable[int] = (100, 1000, 10000), k: int = 10, progress: Callable[[tuple], None] | None = None) -> DataFrame:
    """One row per size: both ways of pooling, and the search over the pooled vectors.

    Corpora repeat the given chunks in turn; a first, smaller run is thrown away.
    """
    base = staged(with_ordinal(chunks.select("chunk_ord", "token_ids"), ["chunk_ord"]))
    n, rows = base.count(), []
    for i, size in enumerate([min(50, 4 * n), *sizes] if n else []):
        corpus = staged(resample(base, "ord", n, size).select(F.col("sample_id").alias("chunk_ord"), "token_ids"))
        embed = _timed(pool(corpus, emb, dim))
        joined = _timed(_pool_joined(corpus.select(F.col("chunk_ord").alias("key"), F.col("token_ids").alias("tokens")), emb, dim))
        found = _timed(search_one(staged(pool(corpus, emb, dim)), [float(x) for x in query], k))
        row = (size, embed, joined, found, embed + found, joined + found, speedup(joined + found, embed + found))
        if i:
            rows.append(row)
            if progress:
                progress(row)
    return chunks.sparkSession.createDataFrame(rows, SCHEMA)

"""Exact cosine search, one query or many."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BYTES = 16 << 20
# scores are compared to so many decimals: equal vectors tie whatever the order of their sums
DECIMALS = 12


def search_one(index: DataFrame, query: list[float], k: int = 8, *, key: str = "chunk_ord", vec: str = "vec") -> DataFrame:
    """``(key, score)`` of the ``k`` rows most similar to one vector; ties to the smaller key."""
    q = index.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id long, q array<double>").withColumnRenamed("q", vec)
    return search(q, index, k, dim=len(query), key=key, vec=vec).orderBy("rank").select(key, "score")


def search(queries: DataFrame, index: DataFrame, k: int = 8, *, dim: int, query_key: str = "query_id", key: str = "chunk_ord", vec: str = "vec", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(query_id, rank, key, score)`` of the ``k`` rows most similar to each query.

    Exact: every query meets every row. Queries of at most ``block_bytes`` in all travel to
    the rows, which stay where they are; more are divided into blocks, as are the rows,
    and every block of the one meets every block of the other in a task. Either way ``k``
    rows per query are kept of each meeting. Zero vectors score 0; rows without a full
    vector are left out; ties go to the smaller key.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    q = queries.select(F.col(query_key).alias("q"), F.col(vec).cast("array<double>").alias("v")).where((F.size("v") == dim) & F.col("q").isNotNull())
    rows = index.select(F.col(key).alias("o"), F.col(vec).cast("array<double>").alias("v")).where((F.size("v") == dim) & F.col("o").isNotNull())
    most = max(1, block_bytes // (8 * dim))
    held = q.limit(most + 1).toArrow()
    if len(held) <= most:
        sent = index.sparkSession.sparkContext.broadcast(_vectors(held, "q", dim))
        out = rows.mapInArrow(lambda batches: _best_of(sent.value, batches, dim, k), _HITS)
    else:
        out = _in_blocks(q, rows, dim, k, most)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    ranked = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("key").alias(key), "score")


_HITS = "query_id long, key long, score double"
# rows of a block of the index
ROWS = 1 << 15


def _vectors(t: pa.Table, key: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(t.column(key).combine_chunks(), np.int64), np.asarray(t.column("v").combine_chunks().flatten(), np.float64).reshape(-1, dim)


def _in_blocks(q: DataFrame, rows: DataFrame, dim: int, k: int, most: int) -> DataFrame:
    """Hits of every block of at most about ``most`` queries in every block of about ROWS rows."""
    sides = []
    for d, key, other, size in ((q, "q", "i", most), (rows, "o", "j", ROWS)):
        sides.append((d, key, other, max(1, -(-d.count() // size))))
    (q, _, _, n), (rows, _, _, m) = sides
    q = q.withColumn("i", F.pmod(F.xxhash64("q"), F.lit(n))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    rows = rows.withColumn("j", F.pmod(F.xxhash64("o"), F.lit(m))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))

    def meet(asked: pa.Table, there: pa.Table) -> pa.Table:
        found = list(_best_of(_vectors(asked, "q", dim), there.select(["o", "v"]).to_batches(), dim, k)) if len(asked) and len(there) else []
        return pa.Table.from_batches(found, pa.schema([("query_id", pa.int64()), ("key", pa.int64()), ("score", pa.float64())]))

    return q.groupBy("i", "j").cogroup(rows.groupBy("i", "j")).applyInArrow(meet, _HITS)


def _best_of(asked: tuple[np.ndarray, np.ndarray], batches, dim: int, k: int):
    """The best ``k`` rows of the batches for each query, ties to the smaller key."""
    ids, mat = asked
    if not len(ids) or k <= 0:
        return
    qn = np.sqrt((mat * mat).sum(1))
    best_s = np.full((len(ids), 0), -np.inf)
    best_o = np.zeros((len(ids), 0), np.int64)
    for b in batches:
        for i in range(0, b.num_rows, 2048):
            part = b.slice(i, 2048)
            x = np.asarray(part.column("v").flatten(), np.float64).reshape(-1, dim)
            o = np.asarray(part.column("o"), np.int64)
            scale = qn[:, None] * np.sqrt((x * x).sum(1))[None, :]
            s = np.where(scale > 1e-12, np.round(mat @ x.T / np.where(scale > 1e-12, scale, 1), DECIMALS), 0.0)
            s = np.hstack([best_s, s])
            o = np.hstack([best_o, np.broadcast_to(o, (len(ids), len(o)))])
            order = np.lexsort((o, -s), axis=1)[:, :k]
            best_s, best_o = np.take_along_axis(s, order, 1), np.take_along_axis(o, order, 1)
    m = best_s.shape[1]
    if m:
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)), pa.array(best_o.ravel()), pa.array(best_s.ravel())], ["query_id", "key", "score"])


def with_text(hits: DataFrame, chunks: DataFrame, *, key: str = "chunk_ord") -> DataFrame:
    """Hits with the columns of their chunks; hits without a chunk are dropped."""
    return hits.join(chunks, key)

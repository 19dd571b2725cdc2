"""Lloyd's k-means with fixed seeds and a fixed number of rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import staged
from .order import with_ordinal


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre, the lowest on ties."""
    best, dist = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    for c, centre in enumerate(centres):
        d = ((x - centre) ** 2).sum(1)
        closer = d < dist
        best[closer], dist[closer] = c, d[closer]
    return best


def kmeans(df: DataFrame, dim: int, k: int, *, key: str, vec: str = "vec", rounds: int = 15) -> DataFrame:
    """``(key, cluster)``: labels of the last assignment of ``rounds`` rounds.

    Seeds are the rows at ``min(c * (n // k), n - 1)`` in the order of ``key``; an empty
    cluster keeps its centre; k is held within 1..n. Each round is one pass in which a
    task makes k sums, which are added up before they reach the driver; rows stay where
    they are. Rows without a full vector are left out.
    """
    d = staged(df.select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("v")).where(F.col("key").isNotNull() & (F.size("v") == dim)))
    n = d.count()
    kind = f"key {df.schema[key].dataType.simpleString()}, cluster int"
    if n == 0:
        return df.sparkSession.createDataFrame([], kind).withColumnRenamed("key", key)
    k = max(1, min(k, n))
    places = [min(c * max(1, n // k), n - 1) for c in range(k)]
    at = {r.ord: r.v for r in with_ordinal(d, ["key"]).where(F.col("ord").isin(places)).select("ord", "v").collect()}
    centres = np.array([at[p] for p in places])

    def sums(centres):
        def run(batches):
            total, count = np.zeros((k, dim)), np.zeros(k)
            for b in batches:
                x = np.asarray(b.column("v").flatten(), np.float64).reshape(-1, dim)
                best = _nearest(x, centres)
                np.add.at(total, best, x)
                count += np.bincount(best, minlength=k)
            full = np.hstack([total, count[:, None]])
            c, i = np.indices(full.shape)
            yield pa.RecordBatch.from_arrays([pa.array(c.ravel()), pa.array(i.ravel()), pa.array(full.ravel())], ["c", "i", "s"])

        return run

    for _ in range(rounds - 1):
        both = np.zeros((k, dim + 1))
        for r in d.select("v").mapInArrow(sums(centres), "c long, i long, s double").groupBy("c", "i").agg(F.sum("s").alias("s")).collect():
            both[r.c, r.i] = r.s
        total, count = both[:, :dim], both[:, dim]
        full = count > 0
        centres = centres.copy()
        centres[full] = total[full] / count[full][:, None]

    def label(batches):
        for b in batches:
            x = np.asarray(b.column("v").flatten(), np.float64).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(_nearest(x, centres).astype(np.int32))], ["key", "cluster"])

    return d.mapInArrow(label, kind).withColumnRenamed("key", key)

"""Sums over vectors: means, Gram matrices, principal axes, 2-D layout."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import project


def moments(df: DataFrame, dim: int, vec: str = "vec") -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, sum and second moments (``XᵀX``) of the vectors of ``dim`` numbers.

    Each task brings one block of dim x dim sums; rows never leave their tasks. Null
    vectors, and vectors of another length, are left out.
    """

    def run(batches):
        n, s, g = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            x = np.asarray(b.column("v").flatten(), np.float64).reshape(-1, dim)
            n, s, g = n + len(x), s + x.sum(0), g + x.T @ x
        i, j = np.indices((dim + 1, dim + 1))
        full = np.zeros((dim + 1, dim + 1))
        full[:dim, :dim], full[dim, :dim], full[dim, dim] = g, s, n
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(full.ravel())], ["i", "j", "s"])

    v = df.select(F.col(vec).cast("array<double>").alias("v")).where(F.size("v") == dim)
    full = np.zeros((dim + 1, dim + 1))
    for r in v.mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        full[r.i, r.j] = r.s
    return int(full[dim, dim]), full[dim, :dim], full[:dim, :dim]


def column_means(df: DataFrame, dim: int, vec: str = "vec") -> DataFrame:
    """``(i, mean)`` for every coordinate."""
    n, s, _ = moments(df, dim, vec)
    return df.sparkSession.createDataFrame([(i, float(x) / n) for i, x in enumerate(s)] if n else [], "i int, mean double")


def gram(df: DataFrame, dim: int, vec: str = "vec", *, centered: bool = False) -> np.ndarray:
    n, s, g = moments(df, dim, vec)
    return g - np.outer(s, s) / n if centered and n else g


def top_component(df: DataFrame, dim: int, vec: str = "vec") -> np.ndarray:
    """First principal component of the uncentered vectors, largest coordinate positive."""
    return top_components(df, dim, 1, vec)[0]


def top_components(df: DataFrame, dim: int, count: int, vec: str = "vec") -> np.ndarray:
    """The ``count`` first principal components of the uncentered vectors, one to a row."""
    axes = np.linalg.eigh(gram(df, dim, vec))[1].T[::-1][:count]
    return axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]


def top2_axes(df: DataFrame, dim: int, vec: str = "vec", iterations: int = 60) -> np.ndarray:
    """Two leading axes of the centered vectors by a fixed number of power iterations.

    The start vector and the count of steps are part of the result: with close
    eigenvalues the axes have not converged, so another solver gives others.
    """
    g = gram(df, dim, vec, centered=True)
    # fixed values: start vector of the iteration
    start = np.sin(np.arange(dim) * 12.9898 + 1) * 0.5 + 0.5001
    axes: list[np.ndarray] = []
    for _ in range(2):
        v = start / np.linalg.norm(start)
        for _ in range(iterations):
            v = g @ v
            for a in axes:
                v = v - (v @ a) * a
            n = np.linalg.norm(v)
            v = v / n if n > 1e-12 else v
        axes.append(v)
    return np.array(axes)


def layout(df: DataFrame, dim: int, key: str, vec: str = "vec", axes: np.ndarray | None = None) -> DataFrame:
    """``(key, x, y)``: the vectors (not centered) along the two axes."""
    axes = top2_axes(df, dim, vec) if axes is None else axes
    return df.select(key, project(F.col(vec), list(axes[0])).alias("x"), project(F.col(vec), list(axes[1])).alias("y"))


def normalized_map(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Points moved to the middle of their bounding box and scaled to a span of 1.7."""
    box = points.agg(F.min(x).alias("_ax"), F.max(x).alias("_bx"), F.min(y).alias("_ay"), F.max(y).alias("_by"))
    span = F.greatest(F.col("_bx") - F.col("_ax"), F.col("_by") - F.col("_ay"), F.lit(1e-6))
    mid: Column = (F.col("_ax") + F.col("_bx")) / 2
    mid_y: Column = (F.col("_ay") + F.col("_by")) / 2
    d = points.crossJoin(F.broadcast(box))  # one row
    return d.withColumns({x: (F.col(x) - mid) / span * 1.7, y: (F.col(y) - mid_y) / span * 1.7}).drop("_ax", "_bx", "_ay", "_by")


def pick(points: DataFrame, at_x: float, at_y: float, key: str, radius2: float = 0.01) -> DataFrame:
    """The nearest point within the squared radius, lowest key on ties; no row if there is none."""
    d = (F.col("x") - at_x) * (F.col("x") - at_x) + (F.col("y") - at_y) * (F.col("y") - at_y)
    return points.select(key, d.alias("dist2")).where(F.col("dist2").isNotNull()).orderBy("dist2", key).limit(1).where(F.col("dist2") < radius2)

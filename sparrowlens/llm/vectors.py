"""Valid vectors of a collection, shared by the similarity operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import staged


def as_bytes(x: np.ndarray) -> pa.Array:
    """Rows of a float32 matrix as one Arrow column of bytes, which Spark copies whole and not number by number."""
    x = np.ascontiguousarray(x, np.float32)
    return pa.Array.from_buffers(pa.binary(4 * x.shape[1]), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())


def _valid_units(batches, dim: int, packed: bool):
    """Arrow batches of valid vectors, scaled to length 1."""
    for b in batches:
        lists = b.column("v")
        whole = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False))
        kept = lists.filter(pa.array(whole))
        x = np.asarray(kept.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
        # scaling by the largest entry first keeps the squares of very large or small numbers finite
        top = np.abs(x).max(axis=1, initial=0)
        ok = np.isfinite(top) & (top > 0)
        x = x[ok] / top[ok, None]
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        x += 0.0  # no negative zeros, so that equal vectors have equal hashes
        ords = b.column("ord").filter(pa.array(whole)).filter(pa.array(ok))
        x = x.astype(np.float32)
        yield pa.RecordBatch.from_arrays([ords, as_bytes(x) if packed else pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.float32()))], ["ord", "unit"])


def unit_vectors(df: DataFrame, dim: int, key: str = "chunk_ord", vec: str = "vec", packed: bool = False) -> DataFrame:
    """``(ord, unit)`` of each distinct key with a valid vector, scaled to length 1; with ``packed`` as bytes.

    Valid are vectors of ``dim`` finite numbers that are not all zero; the stored norm is
    not used. Null keys have no identity and are left out. Should one key come with
    several different valid vectors, the smallest (as an array) counts.
    """
    v = df.select(F.col(key).cast("long").alias("ord"), F.col(vec).cast("array<double>").alias("v")).where("ord is not null and v is not null")
    units = lambda d, p: d.mapInArrow(lambda batches: _valid_units(batches, dim, p), f"ord long, unit {'binary' if p else 'array<float>'}")
    # only keys are shuffled, and the vectors of those that repeat
    again = staged(v.groupBy("ord").count().where("count > 1").select("ord"))
    if again.isEmpty():
        return units(v, packed)
    first = units(v.join(again, "ord", "left_semi"), False).groupBy("ord").agg(F.min("unit").alias("unit"))
    if packed:
        pack = lambda batches: (pa.RecordBatch.from_arrays([b.column("ord"), as_bytes(matrix(b.column("unit"), dim))], ["ord", "unit"]) for b in batches)
        first = first.mapInArrow(pack, "ord long, unit binary")
    return units(v.join(again, "ord", "left_anti"), packed).unionByName(first)


def alone_and_equal(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``(ord, unit)`` whose vector may be grouped away: those of a hash of their own, and the rest.

    Only hashes are shuffled to tell them apart, so that a grouping by vector has but
    the few rows that can be equal to sort.
    """
    h = F.xxhash64("unit")
    again = staged(v.groupBy(h.alias("h")).count().where("count > 1").select("h"))
    d = v.withColumn("h", h)
    return d.join(again, "h", "left_anti").drop("h"), d.join(again, "h", "left_semi").drop("h")


def matrix(column, dim: int) -> np.ndarray:
    """Rows of an Arrow column of lists or bytes (without nulls) as one float32 matrix."""
    kind = getattr(column, "type", None)
    if kind is not None and (pa.types.is_binary(kind) or pa.types.is_large_binary(kind)):
        if not len(column):
            return np.zeros((0, dim), np.float32)
        _, at, data = column.buffers()
        at = np.frombuffer(at, np.int32 if pa.types.is_binary(kind) else np.int64)[column.offset :]
        return np.frombuffer(data, np.float32, len(column) * dim, int(at[0])).reshape(-1, dim)
    flat = column.flatten() if hasattr(column, "flatten") else column
    return np.asarray(flat, dtype=np.float32).reshape(-1, dim)

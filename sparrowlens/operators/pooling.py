"""Vectors of windows: weighted mean of token vectors, without the common component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# the driver holds the rows as they come, as doubles, and in order: about four times the doubles
MAX_MODEL_BYTES = 256 << 20


def token_matrix(emb: DataFrame, dim: int, limit: int = MAX_MODEL_BYTES) -> tuple[np.ndarray, np.ndarray] | None:
    """Sorted token ids and weight * vector rows with the weight last; None where making them takes above ``limit`` bytes."""
    rows = limit // ((dim + 1) * 8 * 4)
    t = emb.select("token_id", F.col("vec").cast("array<float>").alias("vec"), F.col("sif").cast("double").alias("sif")).where("sif > 0 and vec is not null").limit(rows + 1).toArrow()
    if len(t) > rows:
        return None
    ids = np.asarray(t.column("token_id").combine_chunks(), np.int64)
    vec = np.asarray(t.column("vec").combine_chunks().flatten(), np.float64).reshape(-1, dim)
    w = np.asarray(t.column("sif").combine_chunks(), np.float64)
    order = np.argsort(ids, kind="stable")
    return ids[order], np.hstack([vec * w[:, None], w[:, None]])[order]


def pool(chunks: DataFrame, emb: DataFrame, dim: int, *, key: str = "chunk_ord", tokens: str = "token_ids", keep: bool = False, held: tuple | Broadcast | None = None) -> DataFrame:
    """``(key, vec)``, or with ``keep`` all columns and ``vec``: sum of weight * vector over sum of weights of the tokens of each row.

    ``emb`` has ``token_id``, ``vec`` and ``sif``. Ids without a row or with weight 0 do
    not count; a row with no weight (or no tokens) gets a zero vector. The token table
    travels with the tasks while making it takes at most MAX_MODEL_BYTES; above, tokens are
    joined. ``held`` is a ``token_matrix`` of ``emb`` that is there already, or the
    broadcast of one.
    """
    held = token_matrix(emb, dim) if held is None else held
    picked = chunks.select(F.col(key).alias("key"), F.col(tokens).alias("tokens"))
    if held is None:
        pooled = _pool_joined(picked, emb, dim).withColumnRenamed("key", key)
        return chunks.drop("vec").join(pooled, key) if keep else pooled
    if keep:
        rows, lists_in = chunks.drop("vec"), tokens
        out = T.StructType([*rows.schema.fields, T.StructField("vec", T.ArrayType(T.DoubleType()))])
    else:
        rows, lists_in = picked, "tokens"
        out = T.StructType([picked.schema["key"], T.StructField("vec", T.ArrayType(T.DoubleType()))])
    passed = [f.name for f in out.fields[:-1]]
    sent = held if isinstance(held, Broadcast) else chunks.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        for b in batches:
            ids, weighted = sent.value  # read by the first batch of a worker; tasks without rows need none
            lists = b.column(lists_in)
            flat = np.asarray(lists.flatten().fill_null(-1), np.int64)
            n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            row = np.repeat(np.arange(b.num_rows), n)
            at = np.minimum(np.searchsorted(ids, flat), max(0, len(ids) - 1))
            ok = ids[at] == flat if len(ids) else np.zeros(len(flat), bool)
            row, at = row[ok], at[ok]
            total = np.zeros((b.num_rows, dim + 1))
            if len(row):
                # rows come in order, so each is one run
                first = np.r_[0, np.nonzero(np.diff(row))[0] + 1]
                for i in range(0, len(first), 4096):
                    a, z = first[i], first[i + 4096] if i + 4096 < len(first) else len(row)
                    total[row[first[i : i + 4096]]] = np.add.reduceat(weighted[at[a:z]], first[i : i + 4096] - a, axis=0)
            w = total[:, dim]
            vec = np.where((w > 1e-8)[:, None], total[:, :dim] / np.where(w > 1e-8, w, 1)[:, None], 0.0)
            lists_out = pa.FixedSizeListArray.from_arrays(pa.array(vec.ravel()), dim).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in passed), lists_out], [*passed, "vec"])

    pooled = rows.mapInArrow(run, out)
    return pooled if keep else pooled.withColumnRenamed("key", key)


def _pool_joined(picked: DataFrame, emb: DataFrame, dim: int) -> DataFrame:
    """The same by a join on the token, for token tables too large to travel."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    t = picked.select("key", F.explode("tokens").alias("token_id")).groupBy("key", "token_id").agg(F.count(F.lit(1)).alias("n"))
    j = t.join(emb.where("sif > 0"), "token_id").select("key", array_to_vector(F.col("vec").cast("array<double>")).alias("v"), (F.col("n") * F.col("sif")).alias("w"))
    mean = j.groupBy("key").agg(F.sum("w").alias("w"), Summarizer.mean(F.col("v"), F.col("w")).alias("m")).where("w > 1e-8")
    zero = F.array_repeat(F.lit(0.0), dim)
    return picked.select("key").join(mean.select("key", vector_to_array("m").alias("m")), "key", "left").select("key", F.coalesce("m", zero).alias("vec"))

"""Model tables: vocabulary, weights, quantized rows, and their reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import CODES, TINY, sif_weight
from .order import prefix_sum

SPECIAL = ("[PAD]", "[UNK]", "[CLS]", "[SEP]")


def _coded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values, offsets, row of each value, step of each row, and codes of a batch of vectors of any length.

    Halves are rounded away from zero, as the column functions do; missing numbers count as 0.
    """
    n = np.asarray(pc.list_value_length(lists), np.int64)
    x = np.nan_to_num(np.asarray(lists.flatten(), np.float64), nan=0.0)
    row = np.repeat(np.arange(len(n)), n)
    top = np.zeros(len(n))
    np.maximum.at(top, row, np.abs(x))
    scale = np.where(top > 1e-8, top / CODES, 0.0)
    y = x * np.where(scale > 0, 1 / np.where(scale > 0, scale, 1), 0.0)[row]
    return x, np.r_[0, np.cumsum(n)], row, scale, np.clip(np.trunc(y + np.copysign(0.5, y)), -CODES, CODES)


def _vectors(df: DataFrame, key: str, vec: str) -> tuple[DataFrame, T.StructField]:
    d = df.select(key, F.col(vec).cast("array<double>").alias("_v")).where("_v is not null")
    return d, d.schema[key]


def quantize_rows(df: DataFrame, key: str, vec: str) -> DataFrame:
    """``(key, scale, codes)``: 8-bit codes with one step per row; null vectors are left out, missing numbers count as 0."""
    d, of = _vectors(df, key, vec)

    def run(batches):
        for b in batches:
            _, bounds, _, scale, codes = _coded(b.column("_v"))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(codes.astype(np.int8)))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(scale), lists], [key, "scale", "codes"])

    return d.mapInArrow(run, T.StructType([of, T.StructField("scale", T.DoubleType()), T.StructField("codes", T.ArrayType(T.ByteType()))]))


def quantize_error(df: DataFrame, key: str, vec: str) -> DataFrame:
    """``(key, scale, max_error, cosine)`` of each row against its codes; 0 for an empty or zero vector."""
    d, of = _vectors(df, key, vec)

    def run(batches):
        for b in batches:
            x, bounds, row, scale, codes = _coded(b.column("_v"))
            back, n = codes * scale[row], len(scale)
            worst = np.zeros(n)
            np.maximum.at(worst, row, np.abs(x - back))
            both, own, coded = (np.bincount(row, w, n) for w in (x * back, x * x, back * back))
            size = np.sqrt(own) * np.sqrt(coded)
            cosine = np.where(size > TINY, both / np.where(size > TINY, size, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(scale), pa.array(worst), pa.array(cosine)], [key, "scale", "max_error", "cosine"])

    return d.mapInArrow(run, T.StructType([of, *(T.StructField(c, T.DoubleType()) for c in ("scale", "max_error", "cosine"))]))


def coded_tokens(tokens: DataFrame, dim: int) -> DataFrame:
    """``(token_id, vec, sif)`` of a token table with each vector as its 8-bit codes give it back; null vectors are left out."""

    def run(batches):
        for b in batches:
            _, bounds, row, scale, codes = _coded(b.column("vec"))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(codes * scale[row]))
            yield pa.RecordBatch.from_arrays([b.column("token_id"), lists, b.column("sif")], ["token_id", "vec", "sif"])

    d = tokens.select(F.col("token_id").cast("long").alias("token_id"), F.col("vec").cast("array<double>").alias("vec"), F.col("sif").cast("double").alias("sif")).where(F.size("vec") == dim)
    return d.mapInArrow(run, "token_id long, vec array<double>, sif double")


def fidelity(errors: DataFrame) -> DataFrame:
    """``(rows, min_cosine, mean_cosine, max_cosine, max_error)`` of quantized rows; 0 for none."""
    zero = F.lit(0.0)
    return errors.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(f("cosine"), zero).alias(f"{n}_cosine") for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))], F.coalesce(F.max("max_error"), zero).alias("max_error"))


def assert_fidelity(report: DataFrame, least: float = 0.98) -> None:
    """Raises if the mean cosine is below ``least``."""
    r = report.first()
    if r.mean_cosine < least:
        raise ValueError(f"mean cosine {r.mean_cosine:.6f} is below {least}")


def compression(df: DataFrame, vec: str) -> DataFrame:
    """``(fp32_bytes, int8_bytes, ratio)`` of the vectors."""
    n = F.sum(F.size(vec)).cast("long")
    d = df.where(F.col(vec).isNotNull()).agg(n.alias("n"), F.count(F.lit(1)).alias("rows"))
    fp32, int8 = F.col("n") * 4, F.col("n") + F.col("rows") * 4
    return d.select(fp32.alias("fp32_bytes"), int8.alias("int8_bytes"), F.round(fp32 / int8, 6).alias("ratio"))


def weighted(vocab: DataFrame, a: float = 1e-3) -> DataFrame:
    """``(token_id, token, sif)`` from the frequencies of a vocabulary."""
    return vocab.select("token_id", "token", sif_weight(F.col("token"), F.col("freq"), F.col("token").isin(*SPECIAL), a).alias("sif"))


def build_vocabulary(counts: DataFrame, size: int) -> DataFrame:
    """``(token_id, token)``: special tokens, single characters and their continuations, then the
    most frequent words (ties by code point order) up to ``size``. The size is the bound of the table."""
    spark = counts.sparkSession
    chars = [chr(c) for c in (*range(97, 123), *range(48, 58))]
    fixed = [*SPECIAL, *chars, *("##" + c for c in chars)]
    head = spark.createDataFrame(list(enumerate(fixed)), "token_id int, token string")
    words = counts.join(F.broadcast(head.select(F.col("token").alias("word"))), "word", "left_anti")
    top = words.orderBy(F.desc("n"), "word").limit(max(0, size - len(fixed)))
    ranked = top.withColumn("token_id", F.row_number().over(Window.orderBy(F.desc("n"), "word")) + F.lit(len(fixed) - 1))
    return head.unionByName(ranked.select("token_id", F.col("word").alias("token")))


def missing_ids(vocab: DataFrame, size: int) -> DataFrame:
    """Ids below ``size`` that have no token."""
    return vocab.sparkSession.range(size).select(F.col("id").cast("int").alias("token_id")).join(vocab.where("token is not null"), "token_id", "left_anti")


def token_of(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """``ids`` with ``token``; unknown ids have an empty one."""
    return ids.join(vocab.select("token_id", "token"), "token_id", "left").withColumn("token", F.coalesce("token", F.lit("")))


def heap_offsets(vocab: DataFrame) -> DataFrame:
    """``(token_id, offset, length)`` of each token in the packed string heap, in bytes."""
    d = vocab.select("token_id", F.octet_length(F.coalesce("token", F.lit(""))).alias("length"))
    return prefix_sum(d, ["token_id"], "length", "offset").select("token_id", "offset", "length")

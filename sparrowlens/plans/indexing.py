"""From documents to an index: tokens, windows, vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.linear import top_component
from ..operators.pooling import pool
from ..operators.search import search
from ..operators.tokenize import tokenize
from ..operators.windows import OVERLAP, SIZE, window_starts, windows
from .staging import staged


def without_axis(pooled: DataFrame, axis: np.ndarray, key: str, *, keep: bool = False) -> DataFrame:
    """``(key, vec, norm)``, or with ``keep`` all columns and ``norm``: pooled vectors without
    their part along ``axis``, or along each of several in turn.

    One pass in Arrow batches, since column expressions over arrays are not compiled.
    Vectors that are null or of another length than the axis come out null.
    """
    axes = np.atleast_2d(np.asarray(axis, float))
    dim = axes.shape[1]
    d = (pooled.drop("norm") if keep else pooled.select(key, "vec")).withColumn("vec", F.col("vec").cast("array<double>"))
    rest = [f for f in d.schema.fields if f.name != "vec"]
    out = T.StructType([*rest, T.StructField("vec", T.ArrayType(T.DoubleType())), T.StructField("norm", T.DoubleType())])

    def run(batches):
        for b in batches:
            lists = b.column("vec")
            full = np.asarray(pc.fill_null(pc.list_value_length(lists), -1)) == dim
            x = np.asarray(lists.filter(pa.array(full)).flatten(), np.float64).reshape(-1, dim)
            for a in axes:
                x = x - np.outer(x @ a, a)
            bounds = pa.array(np.r_[0, np.cumsum(full)] * dim, pa.int32(), mask=np.r_[~full, False])
            lengths = np.full(len(full), np.nan)
            lengths[full] = np.sqrt((x * x).sum(1))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), pa.ListArray.from_arrays(bounds, pa.array(x.ravel())), pa.array(lengths, mask=~full)], out.names)

    return d.mapInArrow(run, out)


def search_tokens(queries: DataFrame, emb: DataFrame, index: DataFrame, k: int = 8, *, dim: int, axis: np.ndarray | None = None, query_key: str = "query_id", key: str = "chunk_ord") -> DataFrame:
    """``(query_id, rank, key, score)`` for queries ``(query_id, token_ids)`` over an index of vectors.

    A query without tokens has no hits; one whose tokens weigh nothing has a zero vector
    and scores 0 against all.
    """
    asked = pool(queries.where(F.size("token_ids") > 0), emb, dim, key=query_key)
    if axis is not None:
        asked = without_axis(asked, axis, query_key)
    return search(asked, index, k, dim=dim, query_key=query_key, key=key)


def search_texts(queries: DataFrame, vocab: DataFrame, emb: DataFrame, index: DataFrame, k: int = 8, *, dim: int, axis: np.ndarray | None = None, query_key: str = "query_id", key: str = "chunk_ord") -> DataFrame:
    """The same for queries ``(query_id, text)``; null and blank texts have no hits."""
    tokens = tokenize(queries.select(query_key, "text").where("text is not null"), vocab)
    return search_tokens(tokens, emb, index, k, dim=dim, axis=axis, query_key=query_key, key=key)


def embed(chunks: DataFrame, emb: DataFrame, dim: int, *, key: str = "chunk_ord", axis: np.ndarray | None = None) -> DataFrame:
    """``(key, vec, norm)`` of windows; the axis is fitted on them where none is given."""
    pooled = pool(chunks, emb, dim, key=key)
    return without_axis(pooled, top_component(pooled, dim) if axis is None else axis, key)


def index_documents(docs: DataFrame, vocab: DataFrame, emb: DataFrame, dim: int, axis: np.ndarray, *, size: int = SIZE, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """Tables ``docs`` and ``chunks`` of the store for documents ``(name, text)``.

    Texts are indexed once each, under the smallest of their names; an empty text has no
    window, but is known; null texts are left out. Only hashes are shuffled to find texts
    that repeat, and the tokens are made once for both tables.
    """
    d = docs.where("text is not null").select(F.sha2("text", 256).alias("doc_hash"), F.col("name").alias("doc_name"), "text")
    again = staged(d.groupBy("doc_hash").count().where("count > 1").select("doc_hash"))
    several = d.join(again, "doc_hash", "left_semi").groupBy("doc_hash").agg(F.min("doc_name").alias("doc_name"), F.first("text").alias("text"))
    t = staged(tokenize(d.join(again, "doc_hash", "left_anti").unionByName(several), vocab))
    w = windows(t, size=size, overlap=overlap).drop("chunk_id")
    # vectors are made in the pass that cuts the windows, so nothing is joined or shuffled
    v = pool(w.withColumn("_id", F.concat_ws("#", "doc_hash", "start")), emb, dim, key="_id", keep=True)
    chunks = without_axis(v.drop("_id"), axis, "doc_hash", keep=True).withColumnRenamed("chunk_text", "text").select("doc_hash", "start", "doc_name", "text", "token_ids", "char_start", "char_end", "vec", "norm")
    return t.select("doc_hash", "doc_name", F.coalesce(F.size(window_starts(F.size("token_ids"), size, overlap)), F.lit(0)).alias("chunk_count"), F.current_timestamp().alias("added_at")), chunks

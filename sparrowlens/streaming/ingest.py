"""Ingestion that indexes every text once, whatever arrives again."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.indexing import index_documents
from ..sources.store import Store


def ingest_batch(store: Store, docs: DataFrame, vocab: DataFrame, emb: DataFrame, dim: int, axis: np.ndarray, *, batch: str | None = None) -> None:
    """Indexes the documents ``(name, text)`` whose text the store does not hold yet."""
    _, new = store.lookup(docs.where("text is not null"))
    meta, chunks = index_documents(new.select("name", "text"), vocab, emb, dim, axis)
    n = meta.agg(F.count(F.lit(1)).alias("docs"), F.sum("chunk_count").alias("chunks")).first()
    if n.docs:
        store.put(meta, chunks, batch, rows=n.chunks)


def ingest_stream(store: Store, docs: DataFrame, vocab: DataFrame, emb: DataFrame, dim: int, axis: np.ndarray, *, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts a query that ingests a stream of documents; each micro-batch writes under its
    number, so a batch that is run again after a failure replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        ingest_batch(store, batch, vocab, emb, dim, axis, batch=f"stream-{number}")

    w = docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()

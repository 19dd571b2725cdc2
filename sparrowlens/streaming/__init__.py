"""Continuous ingestion into the store."""

from .ingest import ingest_batch, ingest_stream

__all__ = ["ingest_batch", "ingest_stream"]

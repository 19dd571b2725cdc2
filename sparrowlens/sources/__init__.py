"""Readers and writers: documents, packed models, and the content-addressed store."""

from .documents import read_corpus, read_documents
from .packed import PackedModelSource, read_packed, register, write_packed
from .store import Store

__all__ = ["PackedModelSource", "Store", "read_corpus", "read_documents", "read_packed", "register", "write_packed"]

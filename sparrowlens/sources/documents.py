"""Documents from text, Markdown, PDF and JSON files."""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TEXT_FILES, extension

_SCHEMA = "name string, text string"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(name, text)``: one row per .txt, .md, .markdown or .pdf file, read whole.

    Markdown stays as it is. PDF pages are joined by blank lines, which needs the package
    ``pypdf`` on the executors; it is only asked for when a PDF is there.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").where(F.col("name").rlike(TEXT_FILES))
    is_pdf = extension(F.col("name")) == "pdf"
    plain = files.where(~is_pdf).select("name", F.decode("content", "UTF-8").alias("text"))
    return plain.unionByName(files.where(is_pdf).mapInArrow(_pdf_texts, _SCHEMA))


def _pdf_texts(batches):
    for b in batches:
        if not b.num_rows:
            continue
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise ImportError("reading PDF files needs the package pypdf") from e
        texts = ["\n\n".join(" ".join((p.extract_text() or "").split("\n")) for p in PdfReader(io.BytesIO(c)).pages) for c in b.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(texts, pa.string())], ["name", "text"])


def read_corpus(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """``(name, text)`` from JSON files that hold an array of such objects, or one object on each of their ``lines``."""
    return spark.read.schema(_SCHEMA).json(path, multiLine=not lines)

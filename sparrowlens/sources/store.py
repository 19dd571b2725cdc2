"""A store of documents and their windows, addressed by content.

Documents are keyed by the hash of their text, windows by hash and start, so that files
of one name never overwrite each other and a text is indexed once whatever its names.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCS = "doc_hash string, doc_name string, chunk_count int, added_at timestamp"
ROWS_PER_FILE = 1 << 16
CHUNKS = "doc_hash string, start int, doc_name string, text string, token_ids array<int>, char_start int, char_end int, vec array<double>, norm double"


class Store:
    """Parquet tables ``docs`` and ``chunks`` below ``path``; windows are divided by hash prefix.

    ``digits`` hex digits of the hash make 16 ** digits folders; more suit a larger store,
    and a store keeps the number it was begun with.
    """

    def __init__(self, spark: SparkSession, path: str, digits: int = 1):
        self.spark, self.path, self.digits = spark, path.rstrip("/"), digits

    def _read(self, name: str, schema: str) -> DataFrame:
        where = f"{self.path}/{name}"
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(where)
        if not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], schema)
        full = schema + (", prefix string" if name == "chunks" else "") + ", batch string"
        return self.spark.read.schema(full).parquet(where).drop("batch")

    def docs(self) -> DataFrame:
        """All documents, the first entry of each text."""
        d = self._read("docs", DOCS)
        return d.groupBy("doc_hash").agg(F.min(F.struct("added_at", "doc_name", "chunk_count")).alias("d")).select("doc_hash", "d.doc_name", "d.chunk_count", "d.added_at")

    def chunks(self) -> DataFrame:
        return self._read("chunks", CHUNKS).drop("prefix")

    def get_doc(self, doc_hash: str) -> DataFrame:
        return self.docs().where(F.col("doc_hash") == doc_hash)

    def get_chunks(self, doc_hash: str) -> DataFrame:
        """Windows of one text by position; only the folder of its prefix is read."""
        d = self._read("chunks", CHUNKS)
        if "prefix" in d.columns:
            d = d.where(F.col("prefix") == doc_hash[: self.digits]).drop("prefix")
        return d.where(F.col("doc_hash") == doc_hash).orderBy("start")

    def lookup(self, docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
        """Documents that are there and those that are not, both with ``doc_hash``."""
        d = docs.withColumn("doc_hash", F.sha2(F.col(text), 256))
        known = self._read("docs", DOCS).select("doc_hash")  # entries may repeat; a half join does not mind
        return d.join(known, "doc_hash", "left_semi"), d.join(known, "doc_hash", "left_anti")

    def put(self, docs: DataFrame, chunks: DataFrame, batch: str | None = None, rows: int = 0) -> None:
        """Adds documents and their windows. A batch of one name replaces itself, so a repeated
        write changes nothing; windows are written first, so no document lacks them. ``rows`` is
        about how many windows there are: the tasks that write a folder grow with it."""
        batch = batch or uuid.uuid4().hex
        windows = chunks.select(*[c.split()[0] for c in CHUNKS.split(", ")]).withColumn("prefix", F.substring("doc_hash", 1, self.digits)).withColumn("batch", F.lit(batch))
        files = max(1, -(-rows // (ROWS_PER_FILE * 16**self.digits)))
        salt = F.pmod(F.xxhash64("doc_hash", "start"), F.lit(files))
        windows.repartition(files * 16**self.digits, "prefix", salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "prefix").parquet(f"{self.path}/chunks")
        docs.select(*[c.split()[0] for c in DOCS.split(", ")]).withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/docs")

    def clear(self) -> None:
        """Empties both tables."""
        jvm = self.spark._jvm
        for name in ("docs", "chunks"):
            target = jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, name))
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

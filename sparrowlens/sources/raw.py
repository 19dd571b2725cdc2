"""Exchange files of the model build: manifest, vocabulary, float rows, validation set, report.

All numbers are little-endian; strings are a length and UTF-8 bytes. Float rows and the
vocabulary are written and read in ranges by the tasks; the others hold a model's few examples.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import prefix_sum, with_ordinal
from ..plans.staging import staged

# Fixed values of the format.
MAGIC, VERSION = b"BMPR", 1
_HEAD = struct.Struct("<4s7IfI")
MANIFEST = "vocab_size long, hidden_dim long, unk_id long, cls_id long, sep_id long, pad_id long, sif_a double, pc_dim long, model_name string, model_revision string"
VALIDATION = "example int, text string, token_ids array<int>, reference array<float>"
ROWS_PER_PART = 1 << 16


def _u32(f) -> int:
    raw = f.read(4)
    if len(raw) < 4:
        raise ValueError("the file ends early")
    return struct.unpack("<I", raw)[0]


def _numbers(f, count: int, kind: str) -> np.ndarray:
    raw = f.read(count * np.dtype(kind).itemsize)
    if len(raw) < count * np.dtype(kind).itemsize:
        raise ValueError("the file ends early")
    return np.frombuffer(raw, kind)


def _text(f) -> str:
    n = _u32(f)
    raw = f.read(n)
    if len(raw) < n:
        raise ValueError("the file ends early")
    return raw.decode("utf-8")


def write_manifest(path: str, *, vocab_size: int, hidden_dim: int, unk_id: int = 1, cls_id: int = 2, sep_id: int = 3, pad_id: int = 0, sif_a: float = 1e-3, pc_dim: int = 1, model_name: str = "", model_revision: str = "") -> None:
    with open(path, "wb") as f:
        f.write(_HEAD.pack(MAGIC, VERSION, vocab_size, hidden_dim, unk_id, cls_id, sep_id, pad_id, sif_a, pc_dim))
        for s in (model_name, model_revision):
            b = s.encode("utf-8")
            f.write(struct.pack("<I", len(b)) + b)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest as one row."""
    with open(path, "rb") as f:
        raw = f.read(_HEAD.size)
        if len(raw) < _HEAD.size or raw[:4] != MAGIC:
            raise ValueError("manifest: wrong magic or size")
        _, version, *ids, a, pc = _HEAD.unpack(raw)
        if version != VERSION:
            raise ValueError(f"manifest: version {version} is not supported")
        row = (*ids, float(np.float32(a)), pc, _text(f), _text(f))
    return spark.createDataFrame([row], MANIFEST)


def write_vocabulary(vocab: DataFrame, path: str) -> int:
    """Tokens in the order of their ids: count, offsets, heap; tasks write them to their places.

    Missing tokens are written as empty ones. The format counts the bytes of all tokens in 32 bits.
    """
    d = with_ordinal(vocab.select("token_id", F.coalesce("token", F.lit("")).alias("token")), ["token_id"], "row").withColumn("length", F.octet_length("token"))
    placed = staged(prefix_sum(d, ["row"], "length", "offset"))
    n, heap = placed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("length").cast("long")), F.lit(0))).first()
    if heap >= 1 << 32:
        raise ValueError("vocabulary: tokens of more than 4 GiB")
    with open(path, "wb") as f:
        f.write(struct.pack("<I", n))
        f.truncate(8 + 4 * n + heap)
        f.seek(4 + 4 * n)
        f.write(struct.pack("<I", heap))

    def sections(b):
        offset = np.asarray(b.column("offset"), np.int64)
        yield 4 + 4 * b.column("row")[0].as_py(), offset.astype("<u4").tobytes()
        yield 8 + 4 * n + int(offset[0]), "".join(b.column("token").to_pylist()).encode("utf-8")

    return write_ranges(placed.select("row", "token", "offset"), path, "row", sections)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``(token_id, token)``; every task reads a range of the offsets and its part of the heap."""
    with open(path, "rb") as f:
        n = _u32(f)
        f.seek(4 + 4 * n)
        heap = _u32(f)
    if os.path.getsize(path) < 8 + 4 * n + heap:
        raise ValueError("vocabulary: the file ends early")
    parts = max(1, -(-n // ROWS_PER_PART))

    def read(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for p in b.column("id").to_pylist():
                first, end = p * ROWS_PER_PART, min(n, (p + 1) * ROWS_PER_PART)
                with open(path, "rb") as f:
                    f.seek(4 + 4 * first)
                    offsets = _numbers(f, end - first + 1, "<u4").astype(np.int64)
                    f.seek(8 + 4 * n + int(offsets[0]))
                    part = f.read(int(offsets[-1] - offsets[0]))
                at = (offsets - offsets[0]).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, end), pa.int32()), pa.array([part[x:y].decode("utf-8") for x, y in zip(at, at[1:])], pa.string())], ["token_id", "token"])

    return spark.range(0, parts, 1, parts).mapInArrow(read, "token_id int, token string")


def local(path: str) -> str:
    """The path of a file that tasks open by themselves, in a folder that all of them can reach."""
    kind, _, rest = path.rpartition("://")
    if kind not in ("", "file"):
        raise ValueError(f"{path}: files of fixed layout need a mounted folder")
    return rest.removeprefix("file:")


def write_ranges(df: DataFrame, path: str, row: str, sections) -> int:
    """Each task writes its rows into their place of the file ``path``, which is there already.

    ``sections(batch)`` gives ``(offset, bytes)`` for a batch of consecutive values of
    ``row``. A task that is run again writes the same bytes to the same place.
    """

    def write(batches):
        n = 0
        with open(path, "r+b") as f:
            for b in batches:
                at = np.asarray(b.column(row), np.int64)
                for i, e in zip(starts := [0, *(np.nonzero(np.diff(at) != 1)[0] + 1).tolist()], [*starts[1:], len(at)]):
                    if e > i:
                        for offset, raw in sections(b.slice(i, e - i)):
                            f.seek(offset)
                            f.write(raw)
                n += len(at)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return df.repartitionByRange(row).sortWithinPartitions(row).mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_floats(df: DataFrame, path: str, key: str, vec: str) -> int:
    """Rows of floats one after the other, in the order of ``key``; tasks write them to their places.

    Keys must be unique, vectors of one length and not null.
    """
    d = staged(with_ordinal(df.select(F.col(key).alias("_key"), F.col(vec).cast("array<float>").alias("v")), ["_key"], "row"))
    n, low, high = d.agg(F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v"))).first()
    if n and (low != high or low < 0):
        raise ValueError("floats: vectors must have one length")
    with open(path, "wb") as f:
        f.truncate(4 * n * (low or 0))
    return write_ranges(d.select("row", "v"), path, "row", lambda b: [(4 * low * b.column("row")[0].as_py(), np.asarray(b.column("v").flatten(), "<f4").tobytes())])


def read_floats(spark: SparkSession, path: str, dim: int, rows: int | None = None) -> DataFrame:
    """``(row, vec)`` of a file of floats; with ``rows`` a file of another size is an error."""
    size = os.path.getsize(path)
    if size % (4 * dim) or (rows is not None and size != 4 * dim * rows):
        raise ValueError("floats: the file does not hold whole rows of the expected number")
    total = size // (4 * dim)
    parts = max(1, -(-total // ROWS_PER_PART))

    def read(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for p in b.column("id").to_pylist():
                first, end = p * ROWS_PER_PART, min(total, (p + 1) * ROWS_PER_PART)
                with open(path, "rb") as f:
                    f.seek(4 * dim * first)
                    x = np.frombuffer(f.read(4 * dim * (end - first)), "<f4")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, end)), pa.FixedSizeListArray.from_arrays(pa.array(x), dim).cast(pa.list_(pa.float32()))], ["row", "vec"])

    return spark.range(0, parts, 1, parts).mapInArrow(read, "row long, vec array<float>")


def write_validation(examples: DataFrame, path: str, dim: int) -> int:
    """``(example, text, token_ids, reference)`` in order; references must have ``dim`` numbers."""
    n = 0
    with open(path, "wb") as f:
        f.write(struct.pack("<I", 0))
        for r in examples.orderBy("example").select("text", "token_ids", "reference").toLocalIterator():
            if len(r.reference) != dim:
                raise ValueError("validation: a reference has another length")
            t = r.text.encode("utf-8")
            f.write(struct.pack("<I", len(t)) + t + struct.pack("<I", len(r.token_ids)) + np.asarray(r.token_ids, "<u4").tobytes() + np.asarray(r.reference, "<f4").tobytes())
            n += 1
        f.seek(0)
        f.write(struct.pack("<I", n))
    return n


def read_validation(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """``(example, text, token_ids, reference)``; the records have no index, so one pass reads them."""
    rows = []
    with open(path, "rb") as f:
        for i in range(_u32(f)):
            text, n = _text(f), _u32(f)
            ids, ref = _numbers(f, n, "<u4"), _numbers(f, dim, "<f4")
            rows.append((i, text, ids.astype(int).tolist(), ref.astype(float).tolist()))
    return spark.createDataFrame(rows, VALIDATION)


def report_lines(errors: DataFrame, key: str) -> DataFrame:
    """``(key, line)``: the cosine of every row with five decimals, for a text report."""
    return errors.select(key, F.concat(F.format_string("  %.5f  ", "cosine"), F.col(key).cast("string")).alias("line"))


def report_head(compression: DataFrame, cosines: DataFrame) -> DataFrame:
    """``(line_no, line)``: sizes, ratio and the smallest, mean and largest ``cosine``, for a text report."""
    c = cosines.agg(*[F.coalesce(f("cosine"), F.lit(0.0)).alias(n) for n, f in (("low", F.min), ("mean", F.avg), ("high", F.max))])
    one = compression.crossJoin(F.broadcast(c))  # one row each
    mb = lambda b: F.col(b) / float(1 << 20)
    lines = [("fp32 size: %.4f MB", mb("fp32_bytes")), ("int8 size: %.4f MB", mb("int8_bytes")), ("ratio: %.4fx", F.col("ratio")), ("min cosine: %.6f", F.col("low")), ("mean cosine: %.6f", F.col("mean")), ("max cosine: %.6f", F.col("high"))]
    return one.select(F.posexplode(F.array(*[F.format_string(f, x) for f, x in lines])).alias("line_no", "line"))

"""The packed model: header, string heap, 8-bit rows, steps, weights and components in one file.

Reading gives one row per token, so the columns load into any of the model's tables.
All numbers are little-endian; the header is 40 bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.order import prefix_sum
from ..plans.staging import staged
from .raw import write_ranges

# Fixed values of the format.
MAGIC, VERSION = b"BMND", 1
HEADER = struct.Struct("<4s8If")
SCHEMA = "token_id int, token string, codes array<tinyint>, scale double, sif double"
ROWS_PER_PART = 1 << 16


@dataclass(frozen=True)
class Header:
    """Counts and special ids of a packed model, and where its sections start."""

    vocab: int
    dim: int
    components: int
    unk: int
    cls: int
    sep: int
    pad: int
    sif_a: float
    blob: int = 0

    @property
    def offsets_at(self) -> int:
        return HEADER.size

    @property
    def blob_at(self) -> int:
        return self.offsets_at + 4 * (self.vocab + 1)

    @property
    def codes_at(self) -> int:
        return self.blob_at + self.blob + (4 - self.blob % 4) % 4

    @property
    def scales_at(self) -> int:
        return self.codes_at + self.vocab * self.dim

    @property
    def sif_at(self) -> int:
        return self.scales_at + 4 * self.vocab

    @property
    def components_at(self) -> int:
        return self.sif_at + 4 * self.vocab


def read_header(path: str, magic: bytes = MAGIC) -> Header:
    with open(path, "rb") as f:
        raw = f.read(HEADER.size)
        if len(raw) < HEADER.size:
            raise ValueError("packed model: the file ends within the header")
        found, version, *numbers, a = HEADER.unpack(raw)
        if found != magic:
            raise ValueError(f"packed model: wrong magic {found!r}")
        if version != VERSION:
            raise ValueError(f"packed model: version {version} is not supported")
        vocab = numbers[0]
        f.seek(HEADER.size + 4 * vocab)
        last = f.read(4)
        if len(last) < 4:
            raise ValueError("packed model: the file ends within the offsets")
    return Header(*numbers, a, blob=struct.unpack("<I", last)[0])


def _section(f, at: int, count: int, kind: str) -> np.ndarray:
    f.seek(at)
    raw = f.read(count * np.dtype(kind).itemsize)
    if len(raw) < count * np.dtype(kind).itemsize:
        raise ValueError("packed model: the file ends early")
    return np.frombuffer(raw, kind)


def read_components(path: str, magic: bytes = MAGIC) -> np.ndarray:
    h = read_header(path, magic)
    with open(path, "rb") as f:
        return _section(f, h.components_at, h.components * h.dim, "<f4").reshape(h.components, h.dim)


class _Range(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class _Reader(DataSourceReader):
    """Tasks read ranges of rows straight from the sections, so no task holds the whole file."""

    def __init__(self, path: str, magic: bytes):
        self.path, self.magic = path, magic

    def partitions(self) -> list[InputPartition]:
        n = read_header(self.path, self.magic).vocab
        return [_Range(i, min(n, i + ROWS_PER_PART)) for i in range(0, n, ROWS_PER_PART)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        h, a, n = read_header(self.path, self.magic), partition.first, partition.end - partition.first
        with open(self.path, "rb") as f:
            offsets = _section(f, h.offsets_at + 4 * a, n + 1, "<u4")
            f.seek(h.blob_at + int(offsets[0]))
            heap = f.read(int(offsets[-1] - offsets[0]))
            codes = _section(f, h.codes_at + a * h.dim, n * h.dim, "<i1")
            scales = _section(f, h.scales_at + 4 * a, n, "<f4").astype(np.float64)
            sif = _section(f, h.sif_at + 4 * a, n, "<f4").astype(np.float64)
        base = int(offsets[0])
        tokens = [heap[int(x) - base : int(y) - base].decode("utf-8") for x, y in zip(offsets, offsets[1:])]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * h.dim, pa.int32()), pa.array(codes, pa.int8()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n), pa.int32()), pa.array(tokens, pa.string()), lists, pa.array(scales), pa.array(sif)], ["token_id", "token", "codes", "scale", "sif"])


class PackedModelSource(DataSource):
    """``spark.read.format("packed_model").load(path)``: one row per token."""

    @classmethod
    def name(cls) -> str:
        return "packed_model"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("magic", MAGIC.decode()).encode())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackedModelSource)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """``(token_id, token, codes, scale, sif)`` of a packed model."""
    register(spark)
    return spark.read.format("packed_model").load(path)


def write_packed(model: DataFrame, path: str, components: np.ndarray, *, unk: int = 1, cls: int = 2, sep: int = 3, pad: int = 0, sif_a: float = 1e-3, magic: bytes = MAGIC) -> Header:
    """Writes ``(token_id, token, codes, scale, sif)`` to one file.

    Ids must be 0..V-1 without gaps, codes of one length, components of that length. The
    header and the components are written first; then every task writes its range of
    rows into the sections, so that no rows pass through the driver. The format counts
    the bytes of all tokens in 32 bits.
    """
    components = np.asarray(components, "<f4").reshape(-1, np.asarray(components).shape[-1])
    d = staged(model.select("token_id", F.coalesce("token", F.lit("")).alias("token"), "codes", "scale", "sif"))
    stats = d.selectExpr("count(*) n", "min(token_id) a", "max(token_id) b", "count(distinct token_id) u", "min(size(codes)) d0", "max(size(codes)) d1", "coalesce(sum(cast(octet_length(token) as long)), 0L) heap").first()
    if stats.n and not (stats.a == 0 and stats.b == stats.n - 1 and stats.u == stats.n):
        raise ValueError("packed model: token ids must be 0..V-1, each once")
    if stats.n and not (stats.d0 == stats.d1 == components.shape[1]):
        raise ValueError("packed model: rows and components must have one length")
    if stats.heap >= 1 << 32:
        raise ValueError("packed model: tokens of more than 4 GiB")
    h = Header(stats.n, components.shape[1], len(components), unk, cls, sep, pad, sif_a, blob=stats.heap)
    with open(path, "wb") as f:
        f.write(HEADER.pack(magic, VERSION, h.vocab, h.dim, h.components, unk, cls, sep, pad, sif_a))
        f.truncate(h.components_at + components.nbytes)
        f.seek(h.offsets_at + 4 * h.vocab)
        f.write(struct.pack("<I", h.blob))
        f.seek(h.components_at)
        f.write(components.tobytes())
    placed = prefix_sum(d.withColumn("length", F.octet_length("token")), ["token_id"], "length", "offset")

    def sections(b):
        i, offset = b.column("token_id")[0].as_py(), np.asarray(b.column("offset"), np.int64)
        yield h.offsets_at + 4 * i, offset.astype("<u4").tobytes()
        yield h.blob_at + int(offset[0]), "".join(b.column("token").to_pylist()).encode("utf-8")
        yield h.codes_at + i * h.dim, np.asarray(b.column("codes").flatten(), "<i1").tobytes()
        yield h.scales_at + 4 * i, np.asarray(b.column("scale"), "<f4").tobytes()
        yield h.sif_at + 4 * i, np.asarray(b.column("sif"), "<f4").tobytes()

    write_ranges(placed, path, "token_id", sections)
    return h

"""Arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12
CODES = 127.0


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; over the shorter length should the lengths differ; null if either is null."""
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine for search: 0 where either vector is (nearly) zero. Stored norms save work."""
    return cosine_or(a, b, 0.0, norm_a, norm_b)


def cosine_or(a: Column, b: Column, degenerate: float, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine with a chosen value for degenerate pairs (validation uses 0, checks use 1)."""
    scale = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(scale > TINY, dot(a, b) / scale).otherwise(F.when(scale.isNotNull(), F.lit(degenerate)))


def axpy(a: Column, factor: Column, b: Column) -> Column:
    """``a + factor * b``."""
    return F.zip_with(_double(a), _double(b), lambda x, y: x + factor * y)


def without_component(v: Column, component: Column) -> Column:
    """``v`` minus its part along ``component``."""
    return axpy(v, -dot(v, component), component)


def project(v: Column, axis: list[float]) -> Column:
    """Coordinate along a constant axis."""
    return dot(v, F.array(*[F.lit(float(x)) for x in axis]))


def quantize_scale(v: Column) -> Column:
    """Step of the 8-bit code of a row: largest magnitude / 127, 0 for a zero row."""
    top = F.array_max(F.transform(_double(v), F.abs))
    return F.when(top > 1e-8, top / CODES).otherwise(F.when(v.isNotNull(), F.lit(0.0)))


def quantize(v: Column, scale: Column) -> Column:
    """Codes in -127..127; halves are rounded away from zero."""
    inverse = F.when(scale > 0, 1.0 / scale).otherwise(F.lit(0.0))
    return F.transform(_double(v), lambda x: F.least(F.lit(CODES), F.greatest(F.lit(-CODES), F.round(x * inverse))).cast("tinyint"))


def dequantize(codes: Column, scale: Column) -> Column:
    return F.transform(codes, lambda q: q.cast("double") * scale)


def sif_weight(token: Column, freq: Column, special: Column, a: float = 1e-3) -> Column:
    """``a / (a + freq)``; missing or non-positive frequencies count as 1e-9, special tokens weigh 0."""
    f = F.when(freq > 0, freq).otherwise(F.lit(1e-9))
    return F.when(special | token.isNull(), F.lit(0.0)).otherwise(F.lit(a) / (F.lit(a) + f))

"""Overlapping token windows over token streams."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE, OVERLAP = 128, 32


def window_starts(n: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Start positions of the windows over ``n`` tokens; none for 0 or null.

    Windows advance by ``max(1, size - overlap)``; the first that reaches the end is the
    last, and may be short.
    """
    stride = max(1, size - overlap)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(stride)))).cast("int") * stride
    return F.when(n > 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def windows(tokens: DataFrame, *, size: int = SIZE, overlap: int = OVERLAP, text: str = "text", name: str = "doc_name") -> DataFrame:
    """Rows of ``tokens`` as windows: ``start``, ``n_tok``, ``token_ids``, ``char_start``, ``char_end``,
    ``chunk_text`` and ``chunk_id``, besides the other columns.

    Needs ``token_ids``, ``tok_start``, ``tok_end`` and the text. The characters of a
    window run from its first to its last token. Empty or null streams give no window.
    All windows of a row are cut in one pass over it, so that the text is not copied for each.
    """
    new = {"start", "n_tok", "char_start", "char_end", "chunk_text", "chunk_id"}
    rest = [f for f in tokens.schema.fields if f.name not in {"token_ids", "tok_start", "tok_end", text} | new]
    kinds = [("start", T.IntegerType()), ("n_tok", T.IntegerType()), ("token_ids", T.ArrayType(T.IntegerType())), ("char_start", T.IntegerType()), ("char_end", T.IntegerType()), ("chunk_text", T.StringType())]
    out = T.StructType([*rest, *[T.StructField(n, k) for n, k in kinds]])
    arrow = (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.string())
    stride = max(1, size - overlap)

    def cut(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                of, made = [], []
                for i, (ids, a, e, t) in enumerate(zip(*(part.column(c).to_pylist() for c in ("token_ids", "tok_start", "tok_end", text)))):
                    for s in range(0, max(0, -(-(len(ids) - size) // stride)) * stride + 1, stride) if ids else ():
                        first = a[s] if a and s < len(a) else None
                        last = e[min(s + size, len(e)) - 1] if e else None
                        made.append((s, min(size, len(ids) - s), ids[s : s + size], first, last, None if t is None or first is None or last is None else t[first : max(first, last)]))
                        of.append(i)
                who = pa.array(of, pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(f.name).take(who) for f in rest), *(pa.array([m[j] for m in made], k) for j, k in enumerate(arrow))], out.fieldNames())

    used = [*[f.name for f in rest], *(F.col(c).cast("array<int>").alias(c) for c in ("token_ids", "tok_start", "tok_end")), text]
    return tokens.select(*used).mapInArrow(cut, out).withColumn("chunk_id", F.concat_ws("#", F.col(name), F.col("start")))

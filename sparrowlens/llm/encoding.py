"""Problem 6: encoding texts with a public byte-level BPE vocabulary.

A text is split into words by the tokenizer's pattern; a short word keeps its part
boundaries and the ranks of adjacent parts in two flat arrays, and the pair of least
rank is merged until none is left. Long words use the same rule with a heap.
"""

from __future__ import annotations

import base64
import heapq
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")

# Fixed value: the word pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SHORT, KEPT, NONE = 256, 1 << 18, 1 << 30


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` vocabulary file (base64 token and rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one word."""
    known = ranks.get(word)
    if known is not None:
        return [known]
    if len(word) > SHORT:
        return _encode_long(word, ranks)
    bounds = list(range(len(word) + 1))
    near = [ranks.get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while near:
        least = min(near)
        if least == NONE:
            break
        i = near.index(least)
        del bounds[i + 1], near[i]
        if i < len(near):
            near[i] = ranks.get(word[bounds[i] : bounds[i + 2]], NONE)
        if i:
            near[i - 1] = ranks.get(word[bounds[i - 1] : bounds[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for words too long for repeated scans."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        p = before[i]
        if p >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes texts; words seen before come from a bounded memory."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.ranks, self.words, self.seen = ranks, regex.compile(PATTERN).finditer, {}

    def ids(self, text: str | None) -> list[int]:
        out: list[int] = []
        seen = self.seen
        for m in self.words(text or ""):
            w = m.group()
            got = seen.get(w)
            if got is None:
                got = encode_word(w.encode("utf-8", "replace"), self.ranks)
                if len(w) <= 64:
                    if len(seen) >= KEPT:
                        seen.clear()
                    seen[w] = got
            out += got
        return out


def _sent(spark: SparkSession, folder: str, name: str):
    """The ranks, sent to the tasks once (a vocabulary of fixed size, under 2 MB)."""
    return spark.sparkContext.broadcast(load_ranks(os.path.join(folder, f"{name}.tiktoken")))


def encoded(df: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(key, ids)``: the token ids of each text, without special tokens.

    Empty and null texts give an empty list; the names of special tokens in a text are
    ordinary text; a null key stays null; repeated rows count once, and should one key
    have several texts, each distinct one has a row; other columns are ignored.
    """
    ranks = _sent(df.sparkSession, folder, tokenizer)

    def run(batches):
        e = Encoder(ranks.value)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                ids = [e.ids(t) for t in part.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(ids, pa.list_(pa.int32()))], ["k", "ids"])

    kind = df.schema[key].dataType.simpleString()
    once = _once(df.select(F.col(key).alias("k"), F.col(text).alias("t")))
    return once.mapInArrow(run, f"k {kind}, ids array<int>").select(F.col("k").alias(key), "ids")


def token_counts(df: DataFrame, *, text: str, into: str = "tokens", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``df`` with the number of tokens of ``text`` in the column ``into`` (0 for null), ``text`` dropped."""
    from pyspark.sql import types as T

    ranks = _sent(df.sparkSession, folder, tokenizer)
    rest = [f for f in df.schema.fields if f.name != text]

    def run(batches):
        e = Encoder(ranks.value)
        for b in batches:
            n = [len(e.ids(t)) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), pa.array(n, pa.int64())], [*(f.name for f in rest), into])

    return df.mapInArrow(run, T.StructType([*rest, T.StructField(into, T.LongType())]))


def _once(d: DataFrame) -> DataFrame:
    """Rows without repeats. Only keys are shuffled unless some key does repeat."""
    again = d.groupBy("k").count().where("count > 1").select("k")
    if again.isEmpty():
        return d
    single = d.join(again, d["k"].eqNullSafe(again["k"]), "left_anti")
    return single.unionByName(d.join(again, d["k"].eqNullSafe(again["k"]), "left_semi").distinct())

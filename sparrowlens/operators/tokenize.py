"""WordPiece tokenization of documents, with the span of every token."""

from __future__ import annotations

import functools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_WORD = 100
MAX_VOCABULARY = 2_000_000
_KEPT = 1 << 17


@functools.cache
def _classes() -> re.Pattern:
    from ..functions.text import WHITE

    # Python's re has no \p{P}; the marks are listed once from the Unicode database
    marks = "".join(re.escape(chr(c)) for c in range(0x110000) if unicodedata.category(chr(c))[0] == "P" or c in range(33, 127) and not chr(c).isalnum())
    white = re.sub(r"\\x\{(\w+)\}", lambda m: rf"\u{int(m.group(1), 16):04x}", WHITE)
    return re.compile(f"[{marks}]|[^{marks}{white}]+")


class WordPiece:
    """Greedy longest-match splitting of words over a vocabulary of pieces."""

    def __init__(self, pieces: dict[str, int], unknown: int):
        self.pieces, self.unknown, self.seen = pieces, unknown, {}
        self.longest = max((len(p) for p in pieces), default=0)
        self.words = _classes()

    def split(self, word: str) -> list[int]:
        """Ids of one lower-case word; any failure makes the whole word unknown."""
        got = self.seen.get(word)
        if got is None:
            got = self._split(word)
            if len(self.seen) >= _KEPT:
                self.seen.clear()
            self.seen[word] = got
        return got

    def _split(self, word: str) -> list[int]:
        if len(word) > MAX_WORD:
            return [self.unknown]
        ids, start, n = [], 0, len(word)
        while start < n:
            mark = "##" if start else ""
            for end in range(min(n, start + self.longest), start, -1):
                piece = self.pieces.get(mark + word[start:end])
                if piece is not None:
                    break
            else:
                return [self.unknown]
            ids.append(piece)
            start = end
        return ids

    def encode(self, text: str, *, normalize: bool = True) -> tuple[str, list[int], list[int], list[int]]:
        """Normalized text, ids, and start and end of the word each id belongs to."""
        if normalize and not text.isascii():
            text = unicodedata.normalize("NFKC", text)
        ids, start, end = [], [], []
        for m in self.words.finditer(text):
            got = self.split(m.group().lower())
            ids += got
            start += [m.start()] * len(got)
            end += [m.end()] * len(got)
        return text, ids, start, end


def vocabulary(vocab: DataFrame, limit: int = MAX_VOCABULARY) -> dict[str, int]:
    """Token -> id of a vocabulary of checked size; the smallest id of a repeated token counts."""
    rows = vocab.where("token is not null").groupBy("token").agg(F.min("token_id").alias("token_id")).limit(limit + 1).toArrow()
    if len(rows) > limit:
        raise ValueError(f"a vocabulary may have at most {limit} tokens")
    return dict(zip(rows.column("token").to_pylist(), rows.column("token_id").to_pylist()))


def tokenize(docs: DataFrame, vocab: DataFrame, *, text: str = "text", normalize: bool = True, unknown: str = "[UNK]") -> DataFrame:
    """``docs`` with ``text`` normalized and with ``token_ids``, ``tok_start``, ``tok_end``.

    Spans count code points of the normalized text, and each piece carries the span of
    its whole word. Null texts have null arrays, empty ones empty arrays.
    """
    from pyspark.sql import types as T

    pieces = vocabulary(vocab)
    sent = docs.sparkSession.sparkContext.broadcast((pieces, pieces.get(unknown, 1)))
    ints = T.ArrayType(T.IntegerType())
    new = [T.StructField(n, ints) for n in ("token_ids", "tok_start", "tok_end")]
    rest = [f for f in docs.schema.fields if f.name not in {"token_ids", "tok_start", "tok_end"}]

    def run(batches):
        wp = None
        for b in batches:
            wp = wp or WordPiece(*sent.value)  # tasks without rows need no vocabulary
            done = [(None,) * 4 if t is None else wp.encode(t, normalize=normalize) for t in b.column(text).to_pylist()]
            cols = [pa.array([d[0] for d in done], pa.string()) if f.name == text else b.column(f.name) for f in rest]
            cols += [pa.array([d[j] for d in done], pa.list_(pa.int32())) for j in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in rest] + [f.name for f in new])

    return docs.select(*[f.name for f in rest]).mapInArrow(run, T.StructType([*rest, *new]))


def split_words(words: DataFrame, vocab: DataFrame, *, word: str = "word", unknown: str = "[UNK]") -> DataFrame:
    """``(word, pieces)`` of distinct lower-case words."""
    pieces = vocabulary(vocab)
    sent = words.sparkSession.sparkContext.broadcast((pieces, pieces.get(unknown, 1)))

    def run(batches):
        wp = None
        for b in batches:
            wp = wp or WordPiece(*sent.value)
            w = b.column("word")
            yield pa.RecordBatch.from_arrays([w, pa.array([wp.split(x) for x in w.to_pylist()], pa.list_(pa.int32()))], ["word", "pieces"])

    return words.select(F.col(word).alias("word")).where("word is not null").distinct().mapInArrow(run, "word string, pieces array<int>")


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)``: how often each lower-case word or mark occurs."""
    from ..functions.text import pretokens

    return docs.select(F.explode(pretokens(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))

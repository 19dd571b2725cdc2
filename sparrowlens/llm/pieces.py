"""Problem 2: cutting oversized items at natural boundaries, with overlap.

A hierarchy of separators (paragraph, sentence, word, single token) is tried from the
coarsest to the finest: pieces are packed greedily up to the window, each ends at the
last boundary of the coarsest kind that fits, and the next one starts ``overlap``
tokens before that cut.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import staged

DEFAULT_WINDOW, DEFAULT_OVERLAP = 128, 32

# Abbreviations whose full stop ends no sentence (English, French, German, Spanish).
# Single letters count as abbreviations too (initials, "p. ex.", "z. B.", "i. e.").
ABBREVIATIONS = frozenset(
    "approx cf dr e.g eq esp fig figs i.e jr mr mrs ms prof resp sec sr vol vs "
    "chap env ex fr mlle mme p.ex pp tél "
    "abb abs bspw bzw ca d.h evtl ggf hr inkl nr s.o s.u tab u.a usw vgl z.b zzgl "
    "aprox dra ej ee.uu núm p.ej pág sra srta tel ud uds véase".split()
)

_PARAGRAPH = re.compile(r"(?:\r\n|\r(?!\n)|\n)[^\S\r\n]*(?=\r|\n)")
_SENTENCE = re.compile("[.!?]+[\"'»«“”„‘’‹›)\\]}]*(?=\\s)")
_WORD_BEFORE = re.compile(r"[^\W_](?:[\w.]*\w)?\Z")


def sentence_ends(text: str) -> list[int]:
    """Offsets just after each sentence (with its closing quotes and brackets)."""
    ends = []
    for m in _SENTENCE.finditer(text):
        at = m.start()
        if text[at] == "." and (at + 1 == m.end() or text[at + 1] not in ".!?"):
            word = _WORD_BEFORE.search(text, max(0, at - 24), at)
            if word:
                w = word.group().lower()
                if w in ABBREVIATIONS or (len(w) == 1 and w.isalpha()):
                    continue
        ends.append(m.end())
    return ends


def paragraph_ends(text: str) -> list[int]:
    """Offsets where a blank line (perhaps with blanks or tabs) ends a paragraph."""
    return [m.start() for m in _PARAGRAPH.finditer(text)]


def cuts(n: int, text: str | None, start: np.ndarray | None, end: np.ndarray | None, window: int, overlap: int) -> list[int]:
    """Exclusive ends, in tokens, of all pieces but the last of an item of ``n`` tokens."""
    window = max(1, window)
    overlap = min(max(0, overlap), window - 1)
    if n <= window:
        return []
    levels = []
    if start is not None and end is not None and len(start) == n == len(end):
        if text is not None:
            for offsets in (paragraph_ends(text), sentence_ends(text)):
                levels.append(np.unique(np.searchsorted(start, np.asarray(offsets, np.int64), "left")))
        levels.append(np.nonzero((start[1:] != start[:-1]) | (end[1:] != end[:-1]))[0] + 1)
    out, cut = [], 0
    while True:
        begin = max(0, cut - overlap)
        if n - begin <= window:
            return out
        for level in levels:
            k = int(np.searchsorted(level, begin + window, "right")) - 1
            if k >= 0 and level[k] > cut:
                cut = int(level[k])
                break
        else:
            cut = begin + window
        out.append(cut)


def _option(c: Column, default: int) -> Column:
    return F.coalesce(c, F.lit(default)).cast("int")


def _prepared(df: DataFrame) -> DataFrame:
    """Items that need cutting, with the few columns the cutter reads."""
    window = _option(F.col("window_size"), DEFAULT_WINDOW)
    d = df.select("item_id", "text", F.size("token_ids").alias("n"), "tok_start", "tok_end", F.greatest(window, F.lit(1)).alias("window"), _option(F.col("overlap_size"), DEFAULT_OVERLAP).alias("overlap"))
    return d.where(F.col("n") > F.col("window"))


def _spans(column: pa.ListArray, i: int) -> np.ndarray | None:
    if not column.is_valid()[i].as_py():
        return None
    at = column.offsets
    values = column.values.slice(at[i].as_py(), at[i + 1].as_py() - at[i].as_py())
    return None if values.null_count else values.to_numpy()


def _each(batch: pa.RecordBatch):
    """``(item, text, starts, ends, cuts)`` of each row of a batch."""
    cols = {k: batch.column(k).to_pylist() for k in ("item_id", "text", "n", "window", "overlap")}
    starts, ends = batch.column("tok_start"), batch.column("tok_end")
    for i in range(batch.num_rows):
        s, e = _spans(starts, i), _spans(ends, i)
        overlap = min(max(0, cols["overlap"][i]), cols["window"][i] - 1)
        yield cols["item_id"][i], cols["text"][i], s, e, cols["n"][i], overlap, cuts(cols["n"][i], cols["text"][i], s, e, cols["window"][i], cols["overlap"][i])


def cut_points(df: DataFrame) -> DataFrame:
    """``(item_id, cut_tok)``: each cut of each item with more than ``window_size`` tokens.

    Null options stand for 128 and 32; windows below 1 count as 1, overlaps are held
    within 0 and window - 1. Null or empty token streams have no cuts. Without text
    only word ends serve, without (whole) offsets only the token count. Repeated rows
    count once. Items of any length are processed whole.
    """

    def run(batches):
        for b in batches:
            items, at = [], []
            for item, _, _, _, _, _, c in _each(b):
                items += [item] * len(c)
                at += c
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(at, pa.int32())], ["item_id", "cut_tok"])

    return _prepared(df).mapInArrow(run, "item_id long, cut_tok int").distinct()


def split_items(df: DataFrame) -> DataFrame:
    """``(item_id, piece, start_tok, end_tok, piece_text)`` of every oversized item.

    ``piece_text`` runs from the first character of the first token to the last of the
    last token; null where text or offsets are missing. Same rules as ``cut_points``.
    Items that repeat are dropped before they are cut, so that no text of a piece is shuffled.
    """

    def run(batches):
        for b in batches:
            rows = []
            for item, text, s, e, n, overlap, c in _each(b):
                begin, whole = 0, text is not None and s is not None and e is not None and len(s) == n == len(e)
                for k, end in enumerate([*c, n]):
                    rows.append((item, k, begin, end, text[int(s[begin]) : int(e[end - 1])] if whole else None))
                    begin = max(0, end - overlap)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()))],
                ["item_id", "piece", "start_tok", "end_tok", "piece_text"],
            )

    items = _prepared(df)
    again = staged(items.groupBy("item_id").count().where("count > 1").select(F.col("item_id").alias("again")))
    if not again.isEmpty():
        same = F.col("item_id").eqNullSafe(F.col("again"))
        items = items.join(again, same, "left_anti").unionByName(items.join(again, same, "left_semi").distinct())
    return items.mapInArrow(run, "item_id long, piece int, start_tok int, end_tok int, piece_text string")

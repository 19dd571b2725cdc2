"""Text columns: hashing, word splitting, escaping, previews."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes of punctuation and white space, and the pattern of a word or mark.
PUNCTUATION = r"\p{P}!-/:-@\[-`{-~"
WHITE = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WORD_OR_MARK = "[" + PUNCTUATION + "]|[^" + PUNCTUATION + WHITE + "]+"
TEXT_FILES = r"(?i)\.(txt|md|markdown|pdf)$"


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, in hex."""
    return F.sha2(text, 256)


def pretokens(text: Column) -> Column:
    """Lower-case words and single punctuation marks, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_OR_MARK), F.lit(0))


def extension(name: Column) -> Column:
    """Lower-case extension without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def escape_html(text: Column) -> Column:
    for mark, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(mark), F.lit(safe))
    return text


def query_terms(query: str) -> list[str]:
    """Terms of a query that are marked: split at white space, longer than one character."""
    return [t.lower() for t in query.split() if len(t) > 1]


def highlight(text: Column, query: str) -> Column:
    """Escaped text with every occurrence of a query term in ``<mark>``."""
    safe, terms = escape_html(text), query_terms(query)
    if not terms:
        return safe
    pattern = "(?iu)(" + "|".join(map(re.escape, terms)) + ")"
    return F.regexp_replace(safe, pattern, "<mark>$1</mark>")


def preview(text: Column, length: int = 220) -> Column:
    """The first ``length`` characters, with an ellipsis if there are more."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("…"))).otherwise(text)


def bytes_label(n: Column) -> Column:
    """A size in B, KB, MB or GB with one decimal (none for B)."""
    kb = 1024.0
    return (
        F.when(n < kb, F.concat(n.cast("long").cast("string"), F.lit(" B")))
        .when(n < kb**2, F.concat(F.format_string("%.1f", n / kb), F.lit(" KB")))
        .when(n < kb**3, F.concat(F.format_string("%.1f", n / kb**2), F.lit(" MB")))
        .otherwise(F.concat(F.format_string("%.1f", n / kb**3), F.lit(" GB")))
    )

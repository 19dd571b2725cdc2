"""Problem 5: records that differ only in formatting.

Each record is a tree that is hashed from the leaves up: a leaf is its letters and
digits without case; named fields are an unordered node whose child digests are sorted,
lists an ordered one, of any depth; anything else is a leaf as a whole. Records with one
root digest are copies, confirmed by comparing the full normal forms.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.staging import staged

SALTS = 16
_MARKS = re.compile(r"[\W_]+")
# a colon in a time of day or a link names nothing
_COLON = r"(?:=|:(?!//)(?!(?<=\d:)\d))"
_NAME = re.compile(rf"""[\s"'>*\-•﻿]*([^\W\d_][\w\- ]*?)[\s"']*{_COLON}(.*)\Z""", re.S)
_ANY_NAME = re.compile(rf"""(?:\A[\W_]*|(?<=[^\w]))([^\W\d_]\w*)["'\s]*{_COLON}""")

# A named field, a list, or a leaf: ("fields", ((name, value), ...)), ("list", (value, ...)), text.
Value = str | tuple


def normal(text: str) -> str:
    """Letters and digits only, without case: the normal form of a leaf."""
    return _MARKS.sub("", text).casefold()


def _json(body: str) -> Value | None:
    """The record of a JSON object or list that makes up the text, marks aside; else None.

    Numbers keep their digits as written, and names that occur twice keep both values.
    """
    end = body.rfind("}" if body[0] == "{" else "]") + 1
    if normal(body[end:]):
        return None
    try:
        data = json.loads(body[:end], strict=False, parse_float=str, parse_int=str, parse_constant=str, object_pairs_hook=lambda pairs: ("fields", pairs))
    except (ValueError, RecursionError):
        return None
    return _valued(data) if data and not isinstance(data, str) else None


def _valued(data) -> Value:
    if isinstance(data, tuple):
        return "fields", tuple((normal(k), _valued(v)) for k, v in data[1])
    if isinstance(data, list):
        return "list", tuple(_valued(v) for v in data)
    return "null" if data is None else normal(str(data))


def record(text: str) -> Value | None:
    """Normal names and values of a text that is a record with named fields, else None.

    Understood are JSON objects and lists of any depth, ``name: value`` and
    ``name = value`` between bars, semicolons or line ends, with names of any length, and,
    where layout was lost, any run of one-word names before a colon or equals sign from
    the start of the text on.
    """
    if ":" not in text and "=" not in text:
        return None
    body = text.strip(" \t\r\n  　﻿>*-")
    if body[:1] in ("{", "["):
        data = _json(body)
        if data is not None:
            return data
    for separator in ("|", ";", "\n"):
        if separator in body:
            parts = [m for m in body.split(separator) if normal(m)]
            named = [_NAME.match(m) for m in parts]
            if len(parts) > 1 and all(named):
                return "fields", tuple((normal(m.group(1)), normal(m.group(2))) for m in named)
    names = list(_ANY_NAME.finditer(body))
    if len(names) > 1 and not normal(body[: names[0].start(1)]):
        ends = [m.start(1) for m in names[1:]] + [len(body)]
        return "fields", tuple((normal(m.group(1)), normal(body[m.end() : e])) for m, e in zip(names, ends))
    return None


def _digest(*parts: bytes) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        h.update(len(p).to_bytes(8, "little"))
        h.update(p)
    return h.digest()


def merkle(value: Value) -> tuple[bytes, str]:
    """Digest and full normal form of a record, from the leaves up.

    The digest of a node is made of the digests of its children: those of named fields in
    the order of the digests, so that the order of fields does not matter; those of a list in
    the order of the list.
    """
    if isinstance(value, str):
        return _digest(b"leaf", value.encode()), value
    kind, children = value
    if kind == "list":
        made = [merkle(v) for v in children]
        return _digest(b"list", *(d for d, _ in made)), "[" + "\x1e".join(f for _, f in made) + "]"
    made = sorted((_digest(b"field", _digest(b"leaf", n.encode()), d), f"{n}\x1f{f}") for n, (d, f) in ((n, merkle(v)) for n, v in children))
    return _digest(b"node", *(d for d, _ in made)), "{" + "\x1e".join(f for _, f in made) + "}"


_RECORD = "id long, leaf binary, leaf_form string, node binary, node_form string"


def hashed_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Digests and normal forms of free texts; texts without letter or digit are left out."""

    def run(batches):
        for b in batches:
            rows = []
            for i, t in zip(b.column("id").to_pylist(), b.column("t").to_pylist()):
                flat = normal(t)
                if flat:
                    r = record(t)
                    node = merkle(r) if r else (None, None)
                    rows.append((i, _digest(b"leaf", flat.encode()), flat, *node))
            yield _batch(rows)

    return df.select(F.col(key).alias("id"), F.col(text).alias("t")).where("id is not null and t is not null").mapInArrow(run, _RECORD)


def hashed_records(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Digests of rows whose columns must all agree; rows with an empty column are left out."""

    def run(batches):
        for b in batches:
            rows = []
            for i, *values in zip(b.column("id").to_pylist(), *(b.column(f"c{j}").to_pylist() for j in range(len(columns)))):
                parts = [normal(v) for v in values]
                if all(parts):
                    rows.append((i, _digest(b"row", *(_digest(b"leaf", p.encode()) for p in parts)), "\x1f".join(parts), None, None))
            yield _batch(rows)

    picked = df.select(F.col(key).alias("id"), *(F.col(c).cast("string").alias(f"c{j}") for j, c in enumerate(columns))).dropna()
    return picked.mapInArrow(run, _RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.string(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], ["id", "leaf", "leaf_form", "node", "node_form"])


def copies(records: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, first_id, copy_id)``: each copy with the smallest id of its group.

    Two records are linked when their leaf forms are equal, or when both are records with
    the same named values; groups are the components of these links, so that a text
    that can be read in two ways ties both readings together, and one of which the layout
    is lost is tied by its letters. Repeated rows count once; null keys, null texts and
    texts without letter or digit are never cases; an empty table gives no rows. Groups of
    any size are counted within tasks first and joined back over salts, so none meets in
    one task.
    """
    by = list(by)
    records = _told_apart(_told_apart(staged(records), by, "leaf"), by, "node")
    leaf = staged(records.groupBy(*by, "leaf", "node").agg(F.min("id").alias("first"), F.max("id").alias("last")))
    root = staged(_rooted(leaf, by))
    groups = leaf.join(root, [*by, "leaf"]).groupBy(*by, "root").agg(F.min("first").alias("first_id"), F.max("last").alias("last_id")).where("first_id < last_id")
    told = root.join(groups, [*by, "root"]).select(*by, "leaf", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    slim = records.select(*by, "leaf", "id", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    return slim.join(told, [*by, "leaf", "salt"]).where("id <> first_id").select(*by, "first_id", F.col("id").alias("copy_id")).distinct()


def _told_apart(records: DataFrame, by: list[str], digest: str) -> DataFrame:
    """``records`` with longer digests where two forms have one digest: there the form itself tells them apart."""
    form = f"{digest}_form"
    # equal smallest and largest forms mean that all are equal
    clash = records.groupBy(*by, digest).agg(F.min(form).alias("low"), F.max(form).alias("high")).where("low <> high").select(*by, digest)
    if clash.isEmpty():
        return records
    told = records.join(clash.withColumn("clash", F.lit(True)), [*by, digest], "left")
    return staged(told.withColumn(digest, F.when(F.col("clash"), F.concat(digest, F.encode(form, "UTF-8"))).otherwise(F.col(digest))).drop("clash"))


def _rooted(leaf: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, leaf, root)``: the group of every leaf digest.

    A leaf without reading is its own group, one with a reading belongs to that node.
    Leaves with several readings tie their nodes together, which takes components.
    """
    node = leaf.where("node is not null")
    read = node.groupBy(*by, "leaf").agg(F.min("node").alias("root"), F.max("node").alias("other"))
    several = read.where("root <> other").select(*by, "leaf", F.col("root").alias("b"))
    root = leaf.select(*by, "leaf").distinct().join(read.select(*by, "leaf", "root"), [*by, "leaf"], "left").withColumn("root", F.coalesce("root", "leaf"))
    if several.isEmpty():
        return root
    # tables are kept apart by putting their name before the digest
    named = lambda c: F.concat(*[F.encode(F.concat(F.col(x), F.lit("\x00")), "UTF-8") for x in by], F.col(c))
    links = node.join(several, [*by, "leaf"]).where("node <> b").select(named("node").alias("a"), named("b").alias("b"))
    tied = connected_components(links).select(F.col("node").alias("_node"), "component")
    root = root.withColumn("_node", named("root")).join(tied, "_node", "left")
    return root.select(*by, "leaf", F.coalesce("component", "root").alias("root"))


def collapsed(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, first_id, copies)``: one record for each group with the number of its members."""
    return found.groupBy(*by, "first_id").agg((F.count(F.lit(1)) + 1).alias("copies"))

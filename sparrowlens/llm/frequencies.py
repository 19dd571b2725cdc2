"""Problem 3: how often every distinct term occurs, and in how many records.

Recursive radix spilling: terms are counted within each task first, the counts are
written to the shared folder and divided by the low bits of the term's hash; a
division that is still too large is divided again by the next bits; each division is
then added up out of core by an embedded database inside its task.
"""

from __future__ import annotations

import os
import tempfile

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import staged

RADIX_BITS = 6
# distinct terms that a task holds before it spills what it has counted
HELD = 1 << 20
_COUNTS = "term string, occurrences long, records long"


def _once(df: DataFrame, key: str, terms: str) -> DataFrame:
    """``(k, t)`` without repeats: lists are only shuffled where their key repeats.

    A repeated key with different lists is one record with the largest list. Rows without
    a key are records of their own, one for each distinct list.
    """
    d = df.select(F.col(key).alias("k"), F.col(terms).alias("t"))
    again = staged(d.groupBy("k").count().where("count > 1 or k is null").select("k"))
    if again.isEmpty():
        return d
    own = F.when(F.col("k").isNull(), F.xxhash64("t"))
    several = d.join(again, d["k"].eqNullSafe(again["k"]), "left_semi").groupBy("k", own.alias("own")).agg(F.max("t").alias("t"))
    return d.join(again, d["k"].eqNullSafe(again["k"]), "left_anti").unionByName(several.select("k", "t"))


def _spilled(df: DataFrame, key: str, terms: str) -> DataFrame:
    """Counts of each term by map task, written to the shared folder.

    A task adds up what its batches hold, so that it brings one row for each of its terms,
    however common; beyond HELD terms it spills and begins again.
    """

    def count(batches):
        import numpy as np

        def added(tables):
            t = pa.concat_tables(tables).group_by("term").aggregate([("occurrences", "sum"), ("records", "sum")])
            return t.rename_columns(["term", "occurrences", "records"])

        held, rows = [], 0
        for b in batches:
            lists = b.column("t")
            flat = lists.flatten()
            row = np.repeat(np.arange(b.num_rows), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
            t = pa.table({"row": row, "term": flat}).filter(pc.is_valid(flat))
            per = t.group_by(["row", "term"]).aggregate([([], "count_all")])
            held.append(per.group_by("term").aggregate([("count_all", "sum"), ([], "count_all")]).rename_columns(["term", "occurrences", "records"]))
            rows += len(held[-1])
            if rows >= HELD:
                held = [added(held)]
                rows = len(held[0])
                if rows >= HELD // 2:
                    yield from held[0].to_batches(max_chunksize=65536)
                    held, rows = [], 0
        if held:
            yield from added(held).to_batches(max_chunksize=65536)

    kind = df.schema[terms].dataType.elementType.simpleString()
    return staged(_once(df, key, terms).select("t").mapInArrow(count, f"term {kind}, occurrences long, records long"))


def _scratch() -> str:
    """Where a task may spill while it runs: the scratch disk that Spark uses itself."""
    for d in (os.environ.get("SPARK_LOCAL_DIRS", "") or os.environ.get("LOCAL_DIRS", "")).split(","):
        if d and os.path.isdir(d):
            return d
    return tempfile.gettempdir()


def _add_up(memory: str):
    def run(batches):
        import duckdb

        with tempfile.TemporaryDirectory(dir=_scratch(), prefix="radix-") as spill:
            con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": spill})
            con.execute("create table counts (part bigint, term varchar, occurrences bigint, records bigint)")
            for b in batches:
                con.register("incoming", pa.Table.from_batches([b]))
                con.execute("insert into counts select part, term, occurrences, records from incoming")
                con.unregister("incoming")
            # one division at a time, so that only its terms are held
            for (part,) in con.execute("select distinct part from counts order by 1").fetchall():
                rows = con.sql("select term, sum(occurrences)::bigint as occurrences, sum(records)::bigint as records from counts where part = ? group by term", params=[part])
                for b in rows.to_arrow_reader(65536):
                    yield b
            con.close()

    return run


def term_frequencies(df: DataFrame, *, key: str = "chunk_ord", terms: str = "token_ids", limit: int = 1_000_000, memory: str = "256MB") -> DataFrame:
    """``(term, occurrences, records)`` of every distinct element of the array column ``terms``.

    Null elements are no terms; null and empty lists have none; repeated rows count once;
    an empty table gives no rows; other columns are ignored. No term is left out or capped.
    ``limit`` is the number of partial counts a division may have before it is divided
    again. A division that is too large and holds but one term is settled: its counts are
    added within tasks before they meet, so a hot term never meets in one task.
    """
    kind = df.schema[terms].dataType.elementType
    h = F.xxhash64("term")
    rows = _spilled(df, key, terms).withColumn("part", F.pmod(h, F.lit(1 << RADIX_BITS)))
    small, alone, shift = [], [], RADIX_BITS
    while True:
        sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("term").alias("low"), F.max("term").alias("high"))
        sizes = staged(sizes.where(F.col("n") > limit).select("part", (F.col("low") == F.col("high")).alias("one")))
        if sizes.isEmpty():
            small.append(rows)
            break
        told = rows.join(sizes, "part", "left")
        small.append(told.where("one is null").drop("one"))
        alone.append(told.where("one").drop("one"))
        large = told.where("not one").drop("one")
        if shift >= 64:
            # terms that agree in all bits of their hash cannot be told apart by it
            alone.append(large)
            break
        # only what is still too large is divided, and written again, by the next bits of its hash
        rows = staged(large.withColumn("part", F.xxhash64("part", F.pmod(F.shiftrightunsigned(h, shift), F.lit(1 << RADIX_BITS)))))
        shift += RADIX_BITS
    divided = _all(small).select("part", F.col("term").cast("string").alias("term"), "occurrences", "records")
    counted = divided.repartition(F.col("part")).mapInArrow(_add_up(memory), _COUNTS).select(F.col("term").cast(kind).alias("term"), "occurrences", "records")
    if alone:
        counted = counted.unionByName(_all(alone).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")))
    return counted


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def marked(counts: DataFrame, records: int, *, rare_below: int = 3, common_above: float = 0.4) -> DataFrame:
    """Adds ``mark``: ``rare`` in fewer than ``rare_below`` records, ``common`` in more than the share of all."""
    common = F.col("records") > F.lit(common_above) * F.lit(records)
    return counts.withColumn("mark", F.when(F.col("records") < rare_below, "rare").when(common, "common"))

"""Running sums and ordinals over a whole table without a single ordering task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged


def prefix_sum(df: DataFrame, order: list[str], value: str, into: str = "before") -> DataFrame:
    """Adds ``into``: the sum of ``value`` over all rows before this one in ``order``.

    Rows are divided into ranges of the order and written with the number of their range;
    only the sum of each range goes to the driver. ``order`` must be unique for a defined
    result; null values count as 0.
    """
    ranged = staged(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    number = F.coalesce(F.col(value), F.lit(0))
    sums = {r["_range"]: r.s for r in ranged.groupBy("_range").agg(F.sum(number).alias("s")).collect()}
    if not sums:
        return df.withColumn(into, F.lit(0).cast("long"))
    before, total = [], 0
    for i in range(max(sums) + 1):
        before.append(total)
        total += sums.get(i, 0)
    base = F.element_at(F.array(*[F.lit(s) for s in before]), F.col("_range") + 1)
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn(into, (base + F.coalesce(F.sum(number).over(w), F.lit(0))).cast("long")).drop("_range")


def with_ordinal(df: DataFrame, order: list[str], into: str = "ord") -> DataFrame:
    """Adds the zero-based position of each row in ``order``."""
    return prefix_sum(df.withColumn("_one", F.lit(1)), order, "_one", into).drop("_one")


def resample(df: DataFrame, ordinal: str, base: int, size: int) -> DataFrame:
    """``size`` rows that repeat the ``base`` rows of a dense ordinal cyclically, with ``sample_id``."""
    ids = df.sparkSession.range(size).select(F.col("id").alias("sample_id"), F.pmod("id", F.lit(base)).alias("_at"))
    return ids.join(df, ids["_at"] == df[ordinal]).drop("_at")

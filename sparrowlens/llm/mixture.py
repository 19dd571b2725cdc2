"""Problem 7: mixing sources to target weights.

Every source gets a budget in tokens. Whole copies of all its texts are allocated
while the budget allows; the rest is drawn by Pareto order sampling: texts are ranked
by the odds of a random number over the odds of their inclusion probability, and the
first in that order are taken until the budget is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged
from .encoding import TOKENIZERS, token_counts

BUCKETS = 4096


def source_name(c: Column) -> Column:
    """One spelling of a source: trimmed, lower case, words joined by underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[\s\p{Z}\-_]+", "_")


def _stock(documents: DataFrame, targets: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Sized distinct texts of the target sources, and the targets themselves."""
    want = targets.select(source_name(F.col("source")).alias("source"), "weight", "max_repeat").where("source is not null and weight > 0")
    want = want.groupBy("source").agg(F.max("weight").alias("weight"), F.max(F.coalesce("max_repeat", F.lit(1))).alias("max_repeat"))
    want = staged(want)
    d = documents.select("doc_id", "text", source_name(F.col("source")).alias("source")).where("doc_id is not null and text is not null")
    d = d.join(F.broadcast(want.select("source")), "source", "left_semi") if want.count() <= 10_000 else d.join(want.select("source"), "source", "left_semi")
    # a text counts once, under its smallest id; copies under other ids are the same text
    mark = F.sha2("text", 256)
    first = d.select("doc_id", "source", mark.alias("mark")).groupBy("mark").agg(F.min(F.struct("doc_id", "source")).alias("f"))
    first = first.select("f.doc_id", "f.source")
    sized = token_counts(d.select("doc_id", "source", "text"), text="text", folder=folder).distinct()
    return staged(sized.join(first, ["doc_id", "source"]).where("tokens > 0")), want


def mixture(documents: DataFrame, targets: DataFrame, *, total: int | None = None, power: float = 0.5, seed: int = 7, folder: str = TOKENIZERS) -> DataFrame:
    """``(doc_id, source, tokens, copies)`` of every text in the mixture, copies >= 1.

    ``total`` is the size of the mixture in tokens; by default the largest one in which
    every source that has texts can hold its share with no text used more often than its
    ``max_repeat``. Targets without texts hold nothing and their weight falls to the
    others in proportion; with a ``total`` that is too large a source gives all it may
    and its share falls short. Inclusion probabilities grow with the size of a text to
    ``power``. Sources are compared without regard to case, blanks and hyphens; null or
    unknown sources, null or empty texts, null ids and repeated rows add nothing.
    """
    stock, want = _stock(documents, targets, folder)
    sums = stock.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("texts"))
    budget = {r.source: r for r in want.join(sums, "source").collect()} if want.count() <= 10_000 else None
    if budget is None:
        raise ValueError("more than 10,000 target sources")
    spark = documents.sparkSession
    if not budget:
        return spark.createDataFrame([], "doc_id long, source string, tokens long, copies int")
    weights = sum(r.weight for r in budget.values())
    share = {s: r.weight / weights for s, r in budget.items()}
    most = min(r.available * r.max_repeat / share[s] for s, r in budget.items())
    size = most if total is None else total
    plan = {}
    for s, r in budget.items():
        tokens = min(size * share[s], r.available * r.max_repeat)
        whole = min(int(tokens // r.available), r.max_repeat)
        plan[s] = (whole, tokens - whole * r.available if whole < r.max_repeat else 0.0)
    scale = _scales(stock, {s: rest for s, (_, rest) in plan.items()}, power)
    table = spark.createDataFrame([(s, int(w), float(rest), float(scale[s])) for s, (w, rest) in plan.items()], "source string, whole int, rest double, scale double")
    d = stock.join(F.broadcast(table), "source")
    p = F.least(F.lit(1.0 - 1e-9), F.greatest(F.lit(1e-12), F.col("scale") * F.pow(F.col("tokens").cast("double"), power)))
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    odds = (u / (1 - u)) / (p / (1 - p))
    # q in (0, 1), increasing with the odds; buckets of q are added up before any order is made
    d = d.withColumn("q", odds / (1 + odds)).withColumn("bucket", F.floor(F.col("q") * BUCKETS).cast("int"))
    b = d.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.join(F.broadcast(b.select("source", "bucket", before.alias("before"), "t")), ["source", "bucket"])
    inside = F.col("before") + F.col("t") <= F.col("rest")
    outside = F.col("before") >= F.col("rest")
    # only the bucket in which the budget ends is put in order; a text enters if its middle fits
    run = F.sum("tokens").over(Window.partitionBy("source").orderBy("q", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = d.where(~inside & ~outside).withColumn("run", run)
    edge = edge.withColumn("extra", (F.col("before") + F.col("run") - F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    sure = d.where(inside | outside).withColumn("extra", inside.cast("int"))
    cols = ["doc_id", "source", "tokens", (F.col("whole") + F.col("extra")).alias("copies")]
    return sure.select(*cols).unionByName(edge.select(*cols)).where("copies > 0")


def _scales(stock: DataFrame, rest: dict[str, float], power: float, rounds: int = 6) -> dict[str, float]:
    """Factor per source with which the expected size of the draw is what is left of the budget.

    Probabilities are capped at 1, so the factor is approached in a few passes, each of
    which brings back one row per source.
    """
    spark = stock.sparkSession
    scale = dict.fromkeys(rest, 0.0)
    weight = F.pow(F.col("tokens").cast("double"), power)
    for i in range(rounds):
        t = spark.createDataFrame([(s, float(x)) for s, x in scale.items()], "source string, scale double")
        capped = F.col("scale") * weight >= 1
        d = stock.join(F.broadcast(t), "source").groupBy("source").agg(F.coalesce(F.sum(F.when(capped, F.col("tokens"))), F.lit(0)).alias("full"), F.coalesce(F.sum(F.when(~capped, F.col("tokens") * weight)), F.lit(0.0)).alias("open"))
        new = {r.source: max(0.0, rest[r.source] - r.full) / r.open if r.open else scale[r.source] for r in d.collect()}
        if all(abs(new[s] - scale[s]) <= 1e-9 * max(1e-12, new[s]) for s in new):
            break
        scale.update(new)
    return scale


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, weight, max_repeat, texts, tokens, most_copies, share)`` of every target source."""
    want = targets.select(source_name(F.col("source")).alias("source"), "weight", "max_repeat").where("source is not null")
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    joined = want.join(got, "source", "left").na.fill(0, ["texts", "tokens", "most_copies"])
    total = mixed.agg(F.sum(F.col("tokens") * F.col("copies")).alias("all"))
    return joined.crossJoin(F.broadcast(total)).select("source", "weight", "max_repeat", "texts", "tokens", "most_copies", F.round(F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)), 6).alias("share"))

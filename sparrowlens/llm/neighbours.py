"""Problem 4: the k most similar vectors of every (or every asked) vector.

A forest of random-projection trees is fitted on a bounded sample; every row is filed
in one leaf of each tree. A query takes leaves from all trees in the order of one
shared priority queue (least violation of the splits on the way) until the next leaf
lies too far behind its splits for what the query has found, and the rows of those
leaves are ranked by their exact cosine. Leaves meet their queries in a shuffle, so
neither rows nor queries pass through the driver. Equal vectors are one row of the
search; of their keys, the smallest that can be asked for follow afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged
from .vectors import alone_and_equal, matrix, unit_vectors


class Forest:
    """Random-projection trees as flat arrays: a heap-ordered complete tree each."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        inner = (1 << depth) - 1
        self.depth, self.trees = depth, trees
        self.axes = np.zeros((trees, inner, sample.shape[1]), np.float32)
        self.cuts = np.zeros((trees, inner), np.float32)
        for t in range(trees):
            held = {0: np.arange(len(sample))}
            for node in range(inner):
                rows = held.pop(node)
                axis = np.zeros(sample.shape[1], np.float32)
                if len(rows) > 1:
                    a, b = rng.choice(rows, 2, replace=False)
                    axis = sample[a] - sample[b]
                if not np.any(axis):
                    axis = rng.standard_normal(sample.shape[1]).astype(np.float32)
                axis = axis / np.linalg.norm(axis)
                along = sample[rows] @ axis
                cut = np.float32(np.median(along)) if len(rows) else np.float32(0)
                self.axes[t, node], self.cuts[t, node] = axis, cut
                held[2 * node + 1], held[2 * node + 2] = rows[along <= cut], rows[along > cut]

    def leaves(self, u: np.ndarray, trees: int | None = None) -> np.ndarray:
        """Leaf number (over all trees) of each row in each (of the first) tree(s): rows x trees."""
        trees = self.trees if trees is None else trees
        out = np.empty((len(u), trees), np.int32)
        for t in range(trees):
            node = np.zeros(len(u), np.int64)
            for _ in range(self.depth):
                off = np.einsum("ij,ij->i", u, self.axes[t, node]) - self.cuts[t, node]
                node = 2 * node + 1 + (off > 0)
            out[:, t] = (t << self.depth) + node - ((1 << self.depth) - 1)
        return out

    def within(self, u: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, leaf)`` of all leaves that the shared queue gives up to the key ``reach`` of each row.

        The key of a node is the largest distance to a split on whose wrong side it lies,
        so it never falls on the way down, and one child of a node has the key of its parent.
        Nodes beyond the reach are not followed: what is left at the bottom is what the
        queue would give if it were popped until its smallest key is beyond the reach.
        """
        row = np.repeat(np.arange(len(u)), self.trees)
        tree, node = np.tile(np.arange(self.trees), len(u)), np.zeros(len(row), np.int64)
        key = np.zeros(len(row), np.float32)
        for _ in range(self.depth):
            off = np.einsum("ij,ij->i", u[row], self.axes[tree, node]) - self.cuts[tree, node]
            row, tree = np.repeat(row, 2), np.repeat(tree, 2)
            node = (2 * node[:, None] + [1, 2]).ravel()
            key = np.maximum(key[:, None], np.stack([off, -off], 1)).ravel()
            keep = key <= reach[row]
            row, tree, node, key = row[keep], tree[keep], node[keep], key[keep]
        return row, ((tree << self.depth) + node - ((1 << self.depth) - 1)).astype(np.int32)


# pairs whose exact cosines are made at once
PAIRS = 1 << 17
_HIT = "ord long, other long, cos double"
_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _rank(points: tuple, asked: tuple, k: int) -> list[tuple]:
    """Up to ``k`` best ``points (ord, unit)`` for each of ``asked (ord, unit, floor)``, above its floor."""
    (o, u), (who, q, floor) = points, asked
    got: list[tuple] = []
    if not len(o) or not len(who):
        return got
    m = min(k + 1, len(u))
    step = max(1, (1 << 22) // len(u))
    for i in range(0, len(q), step):
        s = q[i : i + step] @ u.T
        least = floor[i : i + step] - np.float32(1e-6)
        many = np.nonzero(np.count_nonzero(s >= least[:, None], axis=1) > 4 * m)[0]
        if len(many):
            # what may tie with the worst of the best is kept too: the smaller key must win
            worst = np.partition(s[many], len(u) - m, axis=1)[:, len(u) - m]
            least[many] = np.maximum(least[many], worst - np.float32(1e-6))
        a, b = np.nonzero(s >= least[:, None])
        exact = np.empty(len(a))
        for j in range(0, len(a), PAIRS):
            at = slice(j, j + PAIRS)
            exact[at] = np.einsum("ij,ij->i", q[i + a[at]].astype(np.float64), u[b[at]].astype(np.float64))
        got.append(_first(who[i + a], o[b], exact, k))
    return got


def _rank_group(points: pa.Table, asked: pa.Table, dim: int, k: int) -> pa.Table:
    """The best points of a group of leaves for the queries that visit them.

    ``points`` has ``ord``, ``leaf`` and ``unit``; ``asked`` has ``ord``, ``unit``, ``floor``
    and the list ``leaves`` that the query visits here (null: all).
    """
    got: list[tuple] = []
    if len(points) and len(asked):
        u, o, leaf = matrix(points.column("unit").combine_chunks(), dim), np.asarray(points.column("ord")), np.asarray(points.column("leaf"))
        order = np.lexsort((o, leaf))
        u, o, leaf = u[order], o[order], leaf[order]
        q, who, floor = matrix(asked.column("unit").combine_chunks(), dim), np.asarray(asked.column("ord")), np.asarray(asked.column("floor"), np.float32)
        lists = asked.column("leaves").combine_chunks()
        if lists.null_count:
            got = _rank((o, u), (who, q, floor), k)
        else:
            n = np.diff(np.asarray(lists.offsets))
            visited, row = np.asarray(lists.flatten()), np.repeat(np.arange(len(q)), n)
            by = np.argsort(visited, kind="stable")
            visited, row = visited[by], row[by]
            for x in np.unique(visited):
                p, r = slice(*np.searchsorted(leaf, (x, x + 1))), row[slice(*np.searchsorted(visited, (x, x + 1)))]
                got += _rank((o[p], u[p]), (who[r], q[r], floor[r]), k)
    a, b, c = _first(*(np.concatenate(x) for x in zip(*got)), k) if got else _NONE
    return pa.table({"ord": pa.array(a, pa.int64()), "other": pa.array(b, pa.int64()), "cos": pa.array(c, pa.float64())})


def _first(a: np.ndarray, b: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best other ``b`` of each ``a`` by ``c``, ties to the smaller key."""
    ok = a != b
    a, b, c = a[ok], b[ok], c[ok]
    order = np.lexsort((b, -c, a))
    a, b, c = a[order], b[order], c[order]
    first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    a, b, c = a[first], b[first], c[first]
    start = np.r_[0, np.nonzero(a[1:] != a[:-1])[0] + 1] if len(a) else np.zeros(0, int)
    place = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)])) if len(a) else start
    keep = place < k
    return a[keep], b[keep], c[keep]


def _drawn(v: DataFrame, n: int, sample: int, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """At most ``sample`` rows by the hash of their key; rows beyond a bound of the hash are not sorted."""
    h = F.xxhash64("ord", F.lit(seed))
    few = v if n <= 2 * sample else v.where(F.pmod(h, F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, 2.0 * sample / n))))
    t = few.orderBy(h, "ord").limit(sample).select("ord", "unit").toArrow()
    return np.asarray(t.column("ord"), np.int64), t.column("unit").combine_chunks()


def nearest_neighbours(
    df: DataFrame,
    asked: DataFrame | None = None,
    *,
    key: str = "chunk_ord",
    vec: str = "vec",
    dim: int = 64,
    k: int = 8,
    trees: int = 8,
    leaf: int = 256,
    reach: float = 0.11,
    sample: int = 65536,
    block: int = 32768,
    seed: int = 0,
) -> DataFrame:
    """``(ord, other, cos, rank)``: the ``k`` most similar other keys of each asked key.

    ``asked`` holds the keys to search for in its first column (default: every key).
    Keys with null, short, zero or non-finite vectors are neither cases nor neighbours;
    null keys and repeated rows are ignored; equal cosines rank the smaller key first;
    with fewer than ``k`` others there are fewer rows; an empty table gives none; other
    columns are ignored. The trees are fitted on at most ``sample`` rows, but hold all, and
    grow deeper with their number. A query visits every leaf whose key in the queue is at
    most ``reach`` times the distance of the k-th best row among its own group of leaves
    in two trees and a quarter of the sample; no number of leaves or rows is set. Groups
    of leaves with more than ``block`` rows or queries are divided, so none is cut short.
    """
    every = staged(unit_vectors(df, dim, key, vec))
    # equal vectors are one row, under the smallest key; k + 1 keys are all that a query can need
    alone, equal = alone_and_equal(every)
    w = Window.partitionBy("unit").orderBy("ord")
    least = equal.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    least = least.groupBy("unit").agg(F.sort_array(F.collect_list("ord")).alias("keys")).select(F.element_at("keys", 1).alias("ord"), "unit", "keys")
    same = staged(alone.select("ord", "unit", F.array("ord").alias("keys")).unionByName(least))
    v = same.select("ord", "unit")
    spark = v.sparkSession
    n = v.count()
    if n == 0:
        return spark.createDataFrame([], _HIT + ", rank int")
    depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
    names, drawn = _drawn(v, n, sample, seed)
    drawn = matrix(drawn, dim)
    # so many leaves of a tree, next to each other, make a group of about half a block
    shift = int(np.clip(np.floor(np.log2(max(1.0, block / 2 * (1 << depth) / n))), 0, depth))
    few = max(1, len(names) // 4)
    sent = spark.sparkContext.broadcast((Forest(drawn, trees, depth, seed), names[:few], drawn[:few]))
    mine = every if asked is None else every.join(asked.select(F.col(asked.columns[0]).alias("ord")).where("ord is not null").distinct(), "ord", "left_semi")
    # keys of equal vectors: the vector, spread over salts, finds its smallest key
    salted = same.where("size(keys) > 1").select("unit", F.col("ord").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    mine = mine.withColumn("salt", F.pmod(F.xxhash64("ord"), F.lit(16)).cast("int")).join(salted, ["unit", "salt"], "left")
    mine = staged(mine.select("ord", F.coalesce("rep", "ord").alias("rep"), "salt"))
    wanted = v if asked is None else staged(v.join(mine.select(F.col("rep").alias("ord")).distinct(), "ord", "left_semi"))

    def leaves(batches):
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                at = sent.value[0].leaves(matrix(part.column("unit"), dim))
                yield pa.RecordBatch.from_arrays([part.column("ord"), part.column("unit"), pa.FixedSizeListArray.from_arrays(pa.array(at.ravel()), trees).cast(pa.list_(pa.int32()))], ["ord", "unit", "leaves"])

    placed = staged(v.mapInArrow(leaves, "ord long, unit array<float>, leaves array<int>"))

    def filed(first_trees: int) -> DataFrame:
        """A row for each of the first trees; the lists are taken apart in the JVM."""
        return placed.select("ord", "unit", F.explode(F.slice("leaves", 1, first_trees)).alias("leaf")).withColumn("grp", F.shiftright("leaf", shift))

    def begin(batches):
        """The query's own group in two trees, with the k-th best of the sample as its floor."""
        forest, names, drawn = sent.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                u, ords = matrix(part.column("unit"), dim), np.asarray(part.column("ord"))
                s = u @ drawn.T
                s[ords[:, None] == names[None, :]] = -2
                floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] >= k else np.full(len(u), -2, np.float32)
                own = forest.leaves(u, min(2, trees)) >> shift
                for t in range(own.shape[1]):
                    yield pa.RecordBatch.from_arrays([part.column("ord"), pa.array(own[:, t]), part.column("unit"), pa.array(floor), pa.nulls(len(u), pa.list_(pa.int32()))], ["ord", "grp", "unit", "floor", "leaves"])

    def visit(batches):
        """The groups that hold leaves within reach, with those leaves."""
        forest = sent.value[0]
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                u, floor = matrix(part.column("unit"), dim), np.asarray(part.column("floor"))
                row, at = forest.within(u, (reach * np.sqrt(np.maximum(0, 2 - 2 * floor))).astype(np.float32))
                order = np.lexsort((at, row))
                row, at = row[order], at[order]
                new = np.nonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] >> shift != at[:-1] >> shift)])[0]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(at)].astype(np.int32)), pa.array(at))
                who = pa.array(row[new])
                yield pa.RecordBatch.from_arrays([part.column("ord").take(who), pa.array(at[new] >> shift), part.column("unit").take(who), pa.array(floor[row[new]]), lists], ["ord", "grp", "unit", "floor", "leaves"])

    trip = "ord long, grp int, unit array<float>, floor float, leaves array<int>"

    def met(rows: DataFrame, trips: DataFrame) -> DataFrame:
        """Hits of the groups; where a group has many rows or queries, every part of its rows meets every part of its queries."""
        # one row per group that is too large; of different vectors a group holds about half a block
        sizes = rows.groupBy("grp").count().where(F.col("count") > block).select("grp", F.ceil(F.col("count") / block).cast("int").alias("pb"))
        loads = trips.groupBy("grp").count().where(F.col("count") > block).select("grp", F.ceil(F.col("count") / block).cast("int").alias("qb"))
        parts = staged(sizes.join(loads, "grp", "full").select("grp", F.coalesce("pb", F.lit(1)).alias("pb"), F.coalesce("qb", F.lit(1)).alias("qb")))
        own = lambda c: F.pmod(F.xxhash64("ord"), F.coalesce(c, F.lit(1))).cast("int")
        each = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
        if parts.isEmpty():
            rows, trips = (d.withColumns({"p": F.lit(0), "q": F.lit(0)}) for d in (rows, trips))
        else:
            rows = rows.join(parts, "grp", "left").withColumn("p", own(F.col("pb"))).withColumn("q", each(F.col("qb"))).drop("pb", "qb")
            trips = trips.join(parts, "grp", "left").withColumn("q", own(F.col("qb"))).withColumn("p", each(F.col("pb"))).drop("pb", "qb")
        return rows.groupBy("grp", "p", "q").cogroup(trips.groupBy("grp", "p", "q")).applyInArrow(lambda p, a: _rank_group(p, a, dim, k), _HIT)

    first = staged(wanted.mapInArrow(begin, trip))
    near = staged(_best(met(filed(min(2, trees)), first), k))
    floors = near.where(F.col("rank") == k).select("ord", F.col("cos").cast("float").alias("seen"))
    # the sample holds rows of the table, so its k-th best is a floor as good as that of the groups
    known = first.select("ord", "floor").distinct().join(floors, "ord", "left")
    wanted_now = wanted.join(known, "ord").select("ord", "unit", F.greatest("floor", F.coalesce("seen", F.lit(-2.0).cast("float"))).alias("floor"))
    found = near.select("ord", "other", "cos").unionByName(met(filed(trees), staged(wanted_now.mapInArrow(visit, trip))))
    found = _best(found, k).select("ord", "other", "cos")
    own = F.aggregate("unit", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    found = found.unionByName(wanted.select("ord", F.col("ord").alias("other"), own.alias("cos")))
    found = found.join(same.select(F.col("ord").alias("other"), "keys"), "other").select("ord", F.explode("keys").alias("other"), "cos")
    # one list for all keys of equal vectors, with one more than k since it may hold the key itself
    lists = _best(found, k + 1).groupBy(F.col("ord").alias("rep")).agg(F.collect_list(F.struct((-F.col("cos")).alias("far"), "other")).alias("best"))
    lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    got = mine.join(lists, ["rep", "salt"]).withColumn("best", F.slice(F.sort_array(F.filter("best", lambda e: e["other"] != F.col("ord"))), 1, k))
    got = got.select("ord", F.posexplode("best").alias("place", "e"))
    return got.select("ord", F.col("e.other").alias("other"), (-F.col("e.far")).alias("cos"), (F.col("place") + 1).alias("rank"))


def _best(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("ord").orderBy(F.desc("cos"), "other")
    return hits.groupBy("ord", "other").agg(F.max("cos").alias("cos")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """``(ord_a, ord_b)``, smaller first, each pair once even if it holds both ways."""
    return near.select(F.least("ord", "other").alias("ord_a"), F.greatest("ord", "other").alias("ord_b")).distinct()

"""Problem 1: clusters of mutually similar vectors, with sizes and medoids.

Density clustering over a spatial partition: vectors are reduced by PCA, assigned to
the cells of their nearest pivots (with a margin, so that cells overlap), clustered
by density inside each cell, and the local clusters of different cells are joined
where they share core points. Cells only propose: exact passes on the full vectors set
every row against all centroids, and the rows that no centroid claims against all other
such rows, so members that met in no cell are found there; medoids describe the clusters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import tree_roots
from ..plans.staging import staged
from .vectors import alone_and_equal, as_bytes, matrix, unit_vectors

BLOCK = 1024
# rows that are multiplied with BLOCK others at once: the product stays in the cache of a core
TILE = 256
# rows in one message of the exact passes, and messages that all tasks hold at once
SENT, HELD = 1 << 16, 4


# --- products of vectors in tiles ------------------------------------------------------


def _tiles(u: np.ndarray, c: np.ndarray, upto: np.ndarray | None = None):
    """``(i, j, u[i:] @ c[j:].T)`` in tiles; each product is gone with the next.

    With ``upto``, which does not fall, row ``i`` needs only the columns before ``upto[i]``;
    tiles of which no row needs any are left out.
    """
    room = np.empty(TILE * BLOCK, np.float32)
    for j in range(0, len(c), BLOCK):
        some = c[j : j + BLOCK].T
        first = 0 if upto is None else int(np.searchsorted(upto, j, side="right"))
        for i in range(first, len(u), TILE):
            part = u[i : i + TILE]
            shape = len(part), some.shape[1]
            yield i, j, np.matmul(part, some, out=room[: shape[0] * shape[1]].reshape(shape))


def _best(u: np.ndarray, c: np.ndarray, upto: np.ndarray | None = None, fits=None) -> tuple[np.ndarray, np.ndarray]:
    """Number and cosine of the closest row of ``c`` (the first of equal ones) for each row of ``u``.

    ``fits(rows, columns)`` tells which pairs count; where none does, the cosine is -2.
    """
    best, val = np.zeros(len(u), np.int64), np.full(len(u), -2, np.float32)
    for i, j, s in _tiles(u, c, upto):
        if upto is not None and upto[i] < j + s.shape[1]:
            s[np.arange(j, j + s.shape[1]) >= upto[i : i + len(s), None]] = -2
        if fits is not None:
            s[~fits(slice(i, i + len(s)), slice(j, j + s.shape[1]))] = -2
        top = s.argmax(1)
        x = s[np.arange(len(s)), top]
        win = np.nonzero(x > val[i : i + len(s)])[0]
        best[i + win], val[i + win] = j + top[win], x[win]
    return best, val


def _nearest(u: np.ndarray, c: np.ndarray, own: np.ndarray, top: np.ndarray, weight: np.ndarray | None = None, who: np.ndarray | None = None) -> None:
    """Puts the ``k`` largest cosines of each row of ``u`` to the rows of ``c`` into ``top``.

    ``top`` holds what was found before, largest first, ``who`` the numbers of the rows;
    ``own`` is the row of ``c`` that is the row itself (-1: none). A row of ``weight`` w
    is w neighbours.
    """
    k = top.shape[1]
    for i, j, s in _tiles(u, c):
        me = own[i : i + len(s)] - j
        here = np.nonzero((me >= 0) & (me < s.shape[1]))[0]
        s[here, me[here]] = -2
        # few rows find anything in a further tile
        row = np.nonzero(s.max(1) > top[i : i + len(s), k - 1])[0]
        s, at = s[row], np.arange(len(row))
        found, names = [top[i + row]], [who[i + row] if who is not None else None]
        for _ in range(min(k, s.shape[1])):
            best = s.argmax(1)
            if weight is None:
                found.append(s[at, best, None])
            else:
                found.append(np.where(np.arange(k) < weight[j + best, None], s[at, best, None], -2))
            names.append(j + best[:, None])
            s[at, best] = -3
        found = np.hstack(found)
        order = np.argsort(-found, axis=1, kind="stable")[:, :k]
        top[i + row] = np.take_along_axis(found, order, 1)
        if who is not None:
            who[i + row] = np.take_along_axis(np.hstack(names), order, 1)


def _summed(x: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each of ``n`` groups."""
    total = np.zeros((n, x.shape[1]))
    if len(x):
        order = np.argsort(group, kind="stable")
        start = np.flatnonzero(np.diff(group[order], prepend=-1))
        total[group[order[start]]] = np.add.reduceat(x[order], start, axis=0, dtype=np.float64)
    return total


# --- inside one cell -----------------------------------------------------------------


def _density(u: np.ndarray, k: int, who: np.ndarray | None = None) -> np.ndarray:
    """Cosine of the ``k``-th nearest other row of each row; -2 where there are fewer.

    ``who`` gets the numbers of the ``k`` nearest.
    """
    n = len(u)
    top = np.full((n, k), -2, np.float32)
    if n > k:
        _nearest(u, u, np.arange(n), top, who=who)
    return top[:, k - 1]


def _followed(u: np.ndarray, rho: np.ndarray, link: float, near: np.ndarray | None = None) -> np.ndarray:
    """The nearest denser row of each row, or the row itself if none is within ``link``.

    In the order of density every row before a row is denser (of equal ones the first is).
    ``near``: the nearest rows of each within ``link``, nearest first (-1: none), if known;
    if one of them is denser, the other rows need not be looked at.
    """
    order = np.argsort(-rho, kind="stable")
    place, up = np.empty(len(u), np.int64), np.arange(len(u))
    place[order] = up
    left = up
    if near is not None:
        denser = (near >= 0) & (place[near] < place[:, None])
        found = denser.any(1)
        up = np.where(found, near[up, denser.argmax(1)], up)
        left = np.nonzero(~found[order])[0]
    v = u[order]
    best, cos = _best(v[left], v, upto=left)
    close = np.nonzero(cos >= link)[0]
    up[order[left[close]]] = order[best[close]]
    return up


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _united(close: np.ndarray) -> np.ndarray:
    """Component number of each row of a small symmetric link matrix."""
    a, b = np.nonzero(close)
    low = np.arange(len(close))
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        new = new[new]
        if np.array_equal(new, low):
            return np.unique(low, return_inverse=True)[1]
        low = new


def _normed(m: np.ndarray) -> np.ndarray:
    return (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _assigned(u: np.ndarray, centres: np.ndarray, least: float, spread: float) -> np.ndarray:
    """Best centre of each row, -1 beyond ``least`` or beyond the spread usual for the centre."""
    best, sim = _best(u, centres)
    ok = sim >= least
    count = np.maximum(1, np.bincount(best[ok], minlength=len(centres)))
    mean = np.bincount(best[ok], sim[ok], minlength=len(centres)) / count
    var = np.bincount(best[ok], sim[ok].astype(np.float64) ** 2, minlength=len(centres)) / count - mean**2
    slack = np.maximum(3 * np.sqrt(np.maximum(var, 0)), spread)
    return np.where(ok & (sim >= (mean - slack)[best]), best, -1)


def local_clusters(u: np.ndarray, *, link: float = 0.5, member: float = 0.6, merge: float = 0.75, spread: float = 0.05, min_points: int = 2, min_size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Labels (-1: none) and core flags of the unit rows of one cell.

    A row's density is the cosine of its ``min_points``-th neighbour; it follows its
    nearest denser neighbour, and the trees so made are local clusters. Trees whose
    centroids agree are one cluster; rows far from the centroid leave it, and what is
    left is clustered again by its own densities, which frees clusters that a bridge had
    tied to others, until no more rows find a cluster.
    """
    n = len(u)
    label, core_ever = np.full(n, -1, np.int64), np.zeros(n, bool)
    centres, weight, before = np.zeros((0, u.shape[1]), np.float32), np.zeros(0), n + 1
    while True:
        free = np.nonzero(label < 0)[0]
        if not min_size <= len(free) < before:
            break
        before = len(free)
        near = np.full((len(free), min_points), -1)
        rho = _density(u[free], min_points, near)
        dense = np.nonzero(rho >= link)[0]
        core, rho = free[dense], rho[dense]
        core_ever[core] = True
        # numbers among the rows of the core; a denser row is always one of them
        place = np.full(len(free) + 1, -1)
        place[dense] = np.arange(len(dense))
        v = u[core]
        _, inv = np.unique(_roots(_followed(v, rho, link, place[near[dense]])), return_inverse=True)
        count = np.bincount(inv)
        total = _summed(v, inv, len(count))
        big = count >= min_size
        if not big.any():
            break
        every, weight = np.concatenate([centres, _normed(total[big])]), np.concatenate([weight, count[big]])
        comp = _united(every @ every.T >= merge)
        centres = _normed(_summed(every * weight[:, None], comp, comp.max() + 1))
        for _ in range(2):
            label = _assigned(u, centres, member, spread)
            size = np.bincount(label[label >= 0], minlength=len(centres))
            total = _summed(u[label >= 0], label[label >= 0], len(centres))
            centres, weight = _normed(total[size >= min_size]), size[size >= min_size].astype(float)
            if not len(centres):
                break
        label = _assigned(u, centres, member, spread) if len(centres) else np.full(n, -1, np.int64)
    if len(centres):
        size = np.bincount(label[label >= 0], minlength=len(centres))
        label = np.where((label >= 0) & (size[label] >= min_size), label, -1)
    return label, core_ever


# --- the partition into overlapping cells ---------------------------------------------


def _projection(v: DataFrame, dim: int, kept: float) -> np.ndarray:
    """Columns of the principal axes (of all rows) that hold ``kept`` of the variance."""

    def sums(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            u = matrix(b.column("unit"), dim).astype(np.float64)
            total += u.T @ u
        i, j = np.indices((dim, dim))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "s"])

    gram = np.zeros((dim, dim))
    for r in v.select("unit").mapInArrow(sums, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        gram[r.i, r.j] = r.s
    value, axis = np.linalg.eigh(gram)
    value, axis = np.maximum(value[::-1], 0), axis[:, ::-1]
    r = int(np.searchsorted(np.cumsum(value) / max(value.sum(), 1e-12), kept) + 1)
    return axis[:, : min(r, dim)].astype(np.float32)


def _reduced(u: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return _normed(u @ axes)


_CELL = "rep long, cell long, unit binary"


def _to_cells(rows: DataFrame, pivots: dict[int, np.ndarray], axes: np.ndarray, *, overlap: int, margin: float, fanout: int) -> DataFrame:
    """Each row in the sub-cells of its nearest pivots of its cell, within the margin.

    ``pivots`` is bounded by the caller (at most WAVE cells of at most ``fanout``), so it
    may travel with the tasks. New cell number: old * fanout + pivot + 1.
    """
    dim = axes.shape[0]
    sent = rows.sparkSession.sparkContext.broadcast(({c: _reduced(p, axes) for c, p in pivots.items()}, axes))

    def split(batches):
        pivots, axes = sent.value
        for b in batches:
            u, cell, rep = matrix(b.column("unit"), dim), np.asarray(b.column("cell")), np.asarray(b.column("rep"))
            red = _reduced(u, axes)
            for c in np.unique(cell):
                at = np.nonzero(cell == c)[0]
                s = red[at] @ pivots[c].T
                m = min(overlap, s.shape[1])
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                val = np.take_along_axis(s, top, 1)
                near = val >= val.max(1, keepdims=True) - margin
                who, to = np.repeat(at, m)[near.ravel()], top.ravel()[near.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(rep[who]), pa.array(c * fanout + to + 1), as_bytes(u[who])], ["rep", "cell", "unit"])

    return rows.select("rep", "cell", "unit").mapInArrow(split, _CELL)


WAVE = 1024


class Partition:
    """Overlapping cells over unit rows ``(rep, unit)``, the vectors as bytes.

    Cells above ``limit`` rows are split again by pivots of their own. Rows that no pivot
    tells apart are cut by hash, each piece with the same few rows besides, so that the
    pieces still share core points.
    """

    def __init__(self, points: DataFrame, n: int, axes: np.ndarray, *, target: int, limit: int, overlap: int, margin: float):
        done, rows = [], points.select("rep", F.lit(0).cast("long").alias("cell"), "unit")
        big, before = {0: n}, n
        for level in range(8):
            split = []
            for wave, pivots in self._drawn(rows, big, level, target):
                mine = rows.where(F.col("cell").isin(list(wave)))
                split.append(_to_cells(mine, pivots, axes, overlap=overlap if level == 0 else 2, margin=margin, fanout=1024))
            rows = staged(_all(split[1:], split[0]))
            big = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().where(F.col("count") > limit).collect()}
            if not big:
                self.rows = _all(done, rows)
                return
            done.append(rows.where(~F.col("cell").isin(list(big))))
            rows = rows.where(F.col("cell").isin(list(big)))
            if max(big.values()) > 0.7 * before:
                break
            before = max(big.values())
        cut = {c: -(-size // (limit // 2)) for c, size in big.items()}
        parts = F.element_at(F.create_map(*[F.lit(x) for p in cut.items() for x in p]), F.col("cell"))
        pieces = rows.withColumn("parts", parts).withColumn("h", F.pmod(F.xxhash64("rep", F.lit("piece")), F.lit(1 << 30)))
        few = F.col("h") < F.lit(float(1 << 30)) * 64.0 / F.lit(float(limit // 2)) / F.col("parts")
        every = F.sequence(F.lit(0), F.col("parts") - 1)
        pieces = pieces.withColumn("p", F.explode(F.when(few, every).otherwise(F.array(F.pmod(F.col("h"), F.col("parts")).cast("int")))))
        self.rows = _all(done, pieces.select("rep", (F.col("cell") * 1024 + F.col("p") + 1).alias("cell"), "unit"))

    @staticmethod
    def _drawn(rows: DataFrame, big: dict[int, int], level: int, target: int):
        """Waves of large cells with pivots drawn from their rows by hash."""
        cells = sorted(big)
        for at in range(0, len(cells), WAVE):
            wave = {c: big[c] for c in cells[at : at + WAVE]}
            fanout = min(1024, max(2, -(-max(wave.values()) // target))) if level == 0 else 64
            share = F.create_map(*[F.lit(x) for c, size in wave.items() for x in (c, min(1.0, 2.0 * fanout / size))])
            draw = F.pmod(F.xxhash64("rep", F.lit(level)), F.lit(1 << 30)) / F.lit(float(1 << 30))
            # about twice the pivots needed are drawn; the first of them serve
            drawn = rows.where(F.col("cell").isin(list(wave))).where(draw < F.element_at(share, F.col("cell"))).select("cell", "rep", "unit", draw.alias("d")).collect()
            found: dict[int, list] = {}
            for r in sorted(drawn, key=lambda r: (r.cell, r.d, r.rep)):
                if len(found.setdefault(r.cell, [])) < fanout:
                    found[r.cell].append(r.unit)
            for c in set(wave) - set(found):
                found[c] = [r.unit for r in rows.where(F.col("cell") == c).orderBy("rep").limit(2).collect()]
            yield wave, {c: np.frombuffer(b"".join(x), np.float32).reshape(len(x), -1) for c, x in found.items()}


def _all(done: list[DataFrame], rows: DataFrame) -> DataFrame:
    for d in done:
        rows = rows.unionByName(d)
    return rows


# --- the whole operator ----------------------------------------------------------------

_LOCAL = "rep long, cell long, local long, core boolean, total array<double>, n long"


def similarity_clusters(
    df: DataFrame,
    *,
    key: str = "chunk_ord",
    vec: str = "vec",
    dim: int = 64,
    variance: float = 0.9,
    target: int = 1500,
    limit: int = 16000,
    overlap: int = 4,
    margin: float = 0.2,
    shared: float = 0.3,
    merge: float = 0.82,
    again: float = 0.75,
    member: float = 0.6,
    spread: float = 0.05,
    min_size: int = 3,
) -> DataFrame:
    """``(ord, cluster, closeness)`` of every key that belongs to a cluster.

    ``cluster`` is the smallest key in it, ``closeness`` the cosine to its centroid.
    Keys with null, short, zero or non-finite vectors, null keys, and rows in no
    cluster do not appear; repeated rows count once; an empty table gives no rows;
    other columns are ignored, whatever their names. Rows with the same vector belong
    together: up to ``min_size`` stand for them while clustering, and all get the label.
    """
    v = staged(unit_vectors(df, dim, key, vec, packed=True))
    spark = v.sparkSession
    n = v.count()
    if n == 0:
        return spark.createDataFrame([], "ord long, cluster long, closeness double")
    alone, equal = alone_and_equal(v)
    equal = equal.groupBy("unit").agg(F.min("ord").alias("rep"), F.count(F.lit(1)).alias("copies"))
    same = staged(alone.select("unit", F.col("ord").alias("rep"), F.lit(1).cast("long").alias("copies")).unionByName(equal))
    axes = _projection(same, dim, variance)
    points = same.select("rep", "unit", F.explode(F.sequence(F.lit(1), F.least(F.lit(min_size), F.col("copies")))).alias("i")).select("rep", "unit")
    cells = Partition(points, n, axes, target=target, limit=limit, overlap=overlap, margin=margin).rows
    sent = spark.sparkContext.broadcast(axes)

    def cluster(group: pa.Table) -> pa.Table:
        u = matrix(group.column("unit").combine_chunks(), dim)
        rep, cell = np.asarray(group.column("rep")), group.column("cell")[0].as_py()
        order = np.argsort(rep, kind="stable")
        u, rep = u[order], rep[order]
        label, core = local_clusters(_reduced(u, sent.value), spread=spread, member=member, min_size=min_size)
        k = int(label.max()) + 1 if len(label) else 0
        total = _summed(u[label >= 0], label[label >= 0], k)
        size = np.bincount(label[label >= 0], minlength=k)
        live = np.nonzero(size)[0]
        ids = np.where(label >= 0, cell * (1 << 20) + label, -1)
        return pa.table(
            {
                "rep": pa.array(list(rep) + [None] * len(live), pa.int64()),
                "cell": pa.array([cell] * (len(rep) + len(live)), pa.int64()),
                "local": pa.array(list(ids) + [cell * (1 << 20) + int(x) for x in live], pa.int64()),
                "core": pa.array(list(core) + [None] * len(live), pa.bool_()),
                "total": pa.array([None] * len(rep) + [total[x].tolist() for x in live], pa.list_(pa.float64())),
                "n": pa.array([None] * len(rep) + [int(size[x]) for x in live], pa.int64()),
            }
        )

    found = staged(cells.groupBy("cell").applyInArrow(cluster, _LOCAL))
    local = found.where("rep is null").select("local", "cell", "total", "n")
    member_rows = found.where("rep is not null").select("rep", "cell", "local", "core").distinct()
    comp = staged(_joined(local, member_rows, shared=shared, merge=merge))
    # exact passes: every row against all centroids, on full vectors; the first gives truer
    # centroids, of which those that now agree are one, and shows which rows none claims
    rows = same.select("rep", F.least(F.lit(min_size), F.col("copies")).alias("w"), "unit")
    comp = staged(_alike(comp, staged(_centres(local, comp, dim)), dim, merge=merge))
    first = staged(_closest(rows, _as_rows(_centres(local, comp, dim)), dim, least=member))
    far = first.join(_usual(first.where("other is not null"), "other", "cos", "w", spread), "other", "left")
    rest = far.where("other is null or cos < floor").select("rep", "w", "unit")
    local = staged(_sums(first.where("other is not null"), dim).unionByName(_left_over(rest, dim, min_size=min_size)))
    comp = local.select("local", F.col("local").alias("component")).distinct()
    comp = staged(_alike(comp, staged(_centres(local, None, dim)), dim, merge=again))
    all_rows = same.select("rep", F.col("copies").alias("w"), "unit")
    best = staged(_closest(all_rows, _as_rows(_centres(local, comp, dim)), dim, least=member).where("other is not null"))
    # how far members usually are from their centroid, each key counted, also those of equal vectors
    kept = best.join(_usual(best, "other", "cos", "w", spread), "other").where("cos >= floor")
    named = kept.groupBy("other").agg(F.min("rep").alias("cluster"), F.sum("w").alias("size")).where(F.col("size") >= min_size)
    kept = staged(kept.join(named, "other").select("rep", "w", "unit", F.col("cluster").alias("other")))
    # typical is what is close to the centroid of the members there are now
    final = staged(_sums(kept, dim))
    kept = _to_own(kept, _as_rows(_centres(final, None, dim)), dim)
    kept = kept.select("rep", "w", "unit", F.col("other").alias("cluster"), F.col("cos").alias("closeness"))
    alone = kept.where("w = 1").select(F.col("rep").alias("ord"), "cluster", "closeness")
    if same.where("copies > 1").isEmpty():
        return alone
    # keys of equal vectors: the vector, spread over salts, finds its cluster; its hash does where no two vectors share one
    own = "hash" if _told_apart(same) else "unit"
    hashed = lambda d: d.withColumn("hash", F.xxhash64("unit"))
    salted = hashed(kept.where("w > 1")).select(own, "cluster", "closeness", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    several = hashed(v).select("ord", own, F.pmod(F.xxhash64("ord"), F.lit(16)).cast("int").alias("salt")).join(salted, [own, "salt"]).select("ord", "cluster", "closeness")
    return alone.unionByName(several)


def _told_apart(same: DataFrame) -> bool:
    """Whether the hashes of all these different vectors differ."""
    return same.groupBy(F.xxhash64("unit")).count().where("count > 1").isEmpty()


def _centres(local: DataFrame, comp: DataFrame | None, dim: int) -> DataFrame:
    """``(component, centre, n)``: unit centroids of joined local clusters, and their weight.

    Without ``comp`` every local cluster is a component. Rows of a component come one
    after the other and are added up as they pass.
    """

    def add(batches):
        kept = np.zeros(0, np.int64), np.zeros((0, dim)), np.zeros(0, np.int64)
        for b in batches:
            if len(b):
                ids, total, n = (np.concatenate(x) for x in zip(kept, (np.asarray(b.column("component")), np.asarray(b.column("total").flatten()).reshape(-1, dim), np.asarray(b.column("n")))))
                start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                ids, total, n = ids[start], np.add.reduceat(total, start, axis=0), np.add.reduceat(n, start)
                # the last one may go on
                kept = ids[-1:], total[-1:], n[-1:]
                yield out(ids[:-1], total[:-1], n[:-1])
        yield out(*kept)

    def out(ids, total, n):
        unit = total / np.maximum(np.sqrt((total * total).sum(1, keepdims=True)), 1e-300)
        return pa.RecordBatch.from_arrays([pa.array(ids), _lists(unit, pa.float64()), pa.array(n)], ["component", "centre", "n"])

    c = local.withColumn("component", F.col("local")) if comp is None else local.join(comp, "local")
    c = c.select("component", "total", "n").repartition("component").sortWithinPartitions("component")
    return c.mapInArrow(add, "component long, centre array<double>, n long")


def _usual(best: DataFrame, group: str, cos: str, weight: str, spread: float) -> DataFrame:
    """``(group, floor)``: the cosine below which a row is farther than is usual for its centroid."""
    w, c = F.col(weight), F.col(cos)
    usual = best.groupBy(group).agg((F.sum(w * c) / F.sum(w)).alias("mean"), (F.sum(w * c * c) / F.sum(w)).alias("square"))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean")))
    return usual.select(group, (F.col("mean") - F.greatest(3 * sd, F.lit(spread))).alias("floor"))


def _as_rows(centre: DataFrame) -> DataFrame:
    return staged(centre.select(F.col("component").alias("rep"), F.col("n").alias("w"), F.col("centre").cast("array<float>").alias("unit")))


def _alike(comp: DataFrame, centre: DataFrame, dim: int, *, merge: float) -> DataFrame:
    """``(local, component)`` after joining components whose centroids agree.

    Parts of one cluster that no core point ties together have centroids close to each
    other. Each centroid is set against all and follows the closest one of larger
    weight, so a small part between two clusters does not tie them.
    """
    rows = _as_rows(centre)
    links = _closest(rows, rows, dim, least=merge, larger=True).where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    joined = tree_roots(links).select(F.col("node").alias("component"), F.col("component").alias("low"))
    return comp.join(joined, "component", "left").select("local", F.coalesce("low", "component").alias("component"))


# --- exact passes: rows against all of a table, block by block --------------------------


def _sent(rows: DataFrame, dim: int, value: str = "w"):
    """Messages of at most about SENT rows ``(rep, value, unit)`` to all tasks, sorted by ``rep``, HELD at a time."""
    parts = max(1, -(-rows.count() // SENT))
    held = []
    for i in range(parts):
        t = rows.where(F.pmod(F.xxhash64("rep"), F.lit(parts)) == i).select("rep", value, "unit").toArrow()
        rep = np.asarray(t.column("rep"), np.int64)
        order = np.argsort(rep, kind="stable")
        held.append(rows.sparkSession.sparkContext.broadcast((rep[order], np.asarray(t.column(value))[order], matrix(t.column("unit").combine_chunks(), dim)[order])))
        if len(held) == HELD or i == parts - 1:
            yield held
            held = []


def _spread(rows: DataFrame) -> DataFrame:
    """``rows``, few bytes but much work each, in enough partitions for all cores."""
    parts = min(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // BLOCK))
    return rows.repartition(parts, "rep") if parts > 1 else rows


def _kind(rows: DataFrame) -> str:
    """The type of the vectors: bytes, or lists of numbers."""
    return rows.schema["unit"].dataType.simpleString()


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), kind), x.shape[1]).cast(pa.list_(kind))


def _closest(rows: DataFrame, others: DataFrame, dim: int, *, least: float, larger: bool = False) -> DataFrame:
    """``rows`` with ``other`` and ``cos``: the closest of all ``others``, null below ``least``.

    Ties go to the smaller number; with ``larger`` only others of larger weight count (of
    equal weight, those of smaller number).
    """

    def better(sent):
        def run(batches):
            for b in batches:
                rep, w, u = np.asarray(b.column("rep")), np.asarray(b.column("w")), matrix(b.column("unit"), dim)
                known = np.asarray(b.column("other").is_valid())
                other, cos = np.asarray(b.column("other").fill_null(0)).copy(), np.asarray(b.column("cos")).copy()
                for ids, weight, c in (x.value for x in sent if len(x.value[0])):
                    fits = lambda r, o: (weight[o] > w[r, None]) | ((weight[o] == w[r, None]) & (ids[o] < rep[r, None]))  # noqa: B023, E731
                    top, val = _best(u, c, fits=fits if larger else None)
                    val, new = val.astype(np.float64), ids[top]
                    win = (val >= least) & (~known | (val > cos) | ((val == cos) & (new < other)))
                    other, cos, known = np.where(win, new, other), np.where(win, val, cos), known | win
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("w"), b.column("unit"), pa.array(other, mask=~known), pa.array(cos)], ["rep", "w", "unit", "other", "cos"])

        return run

    out = (_spread(rows) if larger else rows).select("rep", F.col("w").cast("long").alias("w"), "unit", F.lit(None).cast("long").alias("other"), F.lit(-2.0).alias("cos"))
    for sent in _sent(others, dim):
        out = staged(out.mapInArrow(better(sent), f"rep long, w long, unit {_kind(rows)}, other long, cos double"))
    return out


def _sums(rows: DataFrame, dim: int) -> DataFrame:
    """``(local, total, n)``: sums, in parts, of the rows ``(w, unit)`` of each ``other``."""

    def add(batches):
        for b in batches:
            w = np.asarray(b.column("w"))
            ids, inv = np.unique(np.asarray(b.column("other")), return_inverse=True)
            total = _summed(matrix(b.column("unit"), dim).astype(np.float64) * w[:, None], inv, len(ids))
            n = np.bincount(inv, w, minlength=len(ids)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), _lists(total, pa.float64()), pa.array(n)], ["local", "total", "n"])

    return rows.select("w", "unit", "other").mapInArrow(add, "local long, total array<double>, n long")


def _to_own(rows: DataFrame, centre: DataFrame, dim: int) -> DataFrame:
    """``rows`` with ``cos``: the cosine to the centroid whose number is in ``other``."""

    def own(sent):
        def run(batches):
            for b in batches:
                other, cos = np.asarray(b.column("other")), np.asarray(b.column("cos")).copy()
                for ids, _, c in (x.value for x in sent if len(x.value[0])):
                    at = np.minimum(np.searchsorted(ids, other), len(ids) - 1)
                    here = np.nonzero(ids[at] == other)[0]
                    cos[here] = np.einsum("ij,ij->i", matrix(b.column("unit"), dim)[here].astype(np.float64), c[at[here]].astype(np.float64))
                yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("rep", "w", "unit", "other")), pa.array(cos)], ["rep", "w", "unit", "other", "cos"])

        return run

    out = rows.withColumn("cos", F.lit(-2.0))
    for sent in _sent(centre, dim):
        out = staged(out.mapInArrow(own(sent), f"rep long, w long, unit {_kind(rows)}, other long, cos double"))
    return out


def _densities(rows: DataFrame, dim: int, k: int) -> DataFrame:
    """``rows`` with ``rho``: the cosine of the ``k``-th nearest other row, each counted by its weight.

    The further copies of a row of weight 2 and more are neighbours of the first.
    """
    kind = f"rep long, w long, unit {_kind(rows)}, top array<float>"

    def better(sent):
        def run(batches):
            for b in batches:
                rep, u = np.asarray(b.column("rep")), matrix(b.column("unit"), dim)
                top = np.asarray(b.column("top").flatten()).reshape(-1, k).copy()
                for ids, weight, c in (x.value for x in sent if len(x.value[0])):
                    at = np.minimum(np.searchsorted(ids, rep), len(ids) - 1)
                    _nearest(u, c, np.where(ids[at] == rep, at, -1), top, weight)
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("w"), b.column("unit"), _lists(top, pa.float32())], ["rep", "w", "unit", "top"])

        return run

    own = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.when(i < F.col("w"), F.lit(1.0)).otherwise(F.lit(-2.0)).cast("float"))
    out = _spread(rows).select("rep", F.col("w").cast("long").alias("w"), "unit", own.alias("top"))
    for sent in _sent(rows, dim):
        out = staged(out.mapInArrow(better(sent), kind))
    return out.select("rep", "w", "unit", F.element_at("top", k).alias("rho"))


def _uphill(rows: DataFrame, dim: int, link: float) -> DataFrame:
    """``(a, b)``: the nearest denser row ``b`` of each row ``a`` that has one within ``link``.

    Of equal density the row of smaller number counts as denser; of equally near ones the
    smaller number is followed.
    """
    kind = f"rep long, unit {_kind(rows)}, rho float, other long, cos double"

    def better(sent):
        def run(batches):
            blocks = []
            for ids, rho, c in (x.value for x in sent if len(x.value[0])):
                order = np.lexsort((ids, -rho))
                blocks.append((ids[order], -rho[order], c[order]))
            for b in batches:
                # in the order of density the denser rows are a prefix, so only that is multiplied
                b = b.take(pa.array(np.lexsort((np.asarray(b.column("rep")), -np.asarray(b.column("rho"))))))
                rep, u, own = np.asarray(b.column("rep")), matrix(b.column("unit"), dim), -np.asarray(b.column("rho"))
                known = np.asarray(b.column("other").is_valid())
                other, cos = np.asarray(b.column("other").fill_null(0)).copy(), np.asarray(b.column("cos")).copy()
                for ids, fall, c in blocks:
                    denser, ties = np.searchsorted(fall, own), np.searchsorted(fall, own, side="right")
                    for r in np.nonzero(ties > denser)[0]:
                        denser[r] += np.searchsorted(ids[denser[r] : ties[r]], rep[r])
                    top, val = _best(u, c, upto=denser)
                    val, new = val.astype(np.float64), ids[top]
                    win = (val >= link) & (~known | (val > cos) | ((val == cos) & (new < other)))
                    other, cos, known = np.where(win, new, other), np.where(win, val, cos), known | win
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("unit"), b.column("rho"), pa.array(other, mask=~known), pa.array(cos)], ["rep", "unit", "rho", "other", "cos"])

        return run

    out = _spread(rows).select("rep", "unit", "rho", F.lit(None).cast("long").alias("other"), F.lit(-2.0).alias("cos"))
    for sent in _sent(rows, dim, "rho"):
        out = staged(out.mapInArrow(better(sent), kind))
    return out.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))


def _left_over(rest: DataFrame, dim: int, *, link: float = 0.5, min_points: int = 2, min_size: int = 3) -> DataFrame:
    """``(local, total, n)`` of the trees, as in ``local_clusters``, of rows that met in no cell.

    Every row ``(rep, w, unit)`` is set against all others. Numbers are negative, those
    of the clusters of cells positive.
    """
    found = staged(_densities(staged(rest), dim, min_points).where(F.col("rho") >= link))
    tree = tree_roots(_uphill(found, dim, link)).select(F.col("node").alias("rep"), "component")
    tree = staged(found.select("rep", "w", "unit").join(tree, "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    large = tree.groupBy("component").agg(F.sum("w").alias("size")).where(F.col("size") >= min_size)
    large = staged(large.select("component", (-1 - F.monotonically_increasing_id()).alias("other")))
    return _sums(tree.join(large, "component"), dim)


def _cosines(batches):
    """``(a, b, na, nb)`` with the cosine of the sums ``ca`` and ``cb``."""
    for b in batches:
        x, y = (np.asarray(b.column(c).flatten()).reshape(len(b), -1) if len(b) else np.zeros((0, 1)) for c in ("ca", "cb"))
        size = np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))
        cos = (x * y).sum(1) / np.maximum(size, 1e-300)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("a", "b", "na", "nb")), pa.array(cos)], ["a", "b", "na", "nb", "cos"])


def _joined(local: DataFrame, members: DataFrame, *, shared: float, merge: float) -> DataFrame:
    """``(local, component)``: local clusters joined where they share core points.

    Two clusters of overlapping cells are one when, of the core points that lie in both
    cells, they share a fraction, and their centroids agree (one shared bridge does not
    join them).
    """
    g = members.where("core").groupBy("rep").agg(F.collect_set(F.struct("cell", "local")).alias("g")).where(F.size("g") > 1)
    pairs = g.select(F.explode("g").alias("a"), "g").select("a", F.explode("g").alias("b")).where("a.cell <> b.cell and a.local >= 0")
    seen = pairs.groupBy(F.col("a.local").alias("a"), F.col("a.cell").alias("ac"), F.col("b.cell").alias("bc"), F.col("b.local").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    seen = staged(seen)
    present = seen.groupBy("a", "bc").agg(F.sum("n").alias("p"))
    back = present.select(F.col("a").alias("b"), F.col("bc").alias("ac"), F.col("p").alias("q"))
    near = seen.where("b >= 0 and a < b").join(present, ["a", "bc"]).join(back, ["b", "ac"])
    near = near.where(F.col("n") >= shared * F.least("p", "q")).select("a", "b")
    centre = local.select("local", F.col("total").alias("c"), "n")
    near = near.join(centre.select(F.col("local").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na")), "a").join(centre.select(F.col("local").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb")), "b")
    near = near.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(_cosines, "a long, b long, na long, nb long, cos double").where(F.col("cos") >= merge)
    # a cluster follows the closest larger one only: a small part between two does not tie them
    larger = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    near = near.select(F.when(larger, F.col("b")).otherwise(F.col("a")).alias("a"), F.struct("cos", F.when(larger, F.col("a")).otherwise(F.col("b")).alias("b")).alias("up"))
    near = near.groupBy("a").agg(F.max("up").alias("up")).select("a", F.col("up.b").alias("b"))
    comp = tree_roots(near).select(F.col("node").alias("local"), "component")
    return local.select("local").join(comp, "local", "left").select("local", F.coalesce("component", "local").alias("component"))


def describe_clusters(labels: DataFrame, typical: int = 3) -> DataFrame:
    """``(cluster, size, medoids)``: the keys closest to the centroid, best first.

    For cosine the member with the largest mean similarity to all others is the one
    closest to the centroid, so no pair of members is compared. Ties go to the smaller key.
    """
    from pyspark.sql import Window

    size = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy("cluster").orderBy(F.desc("closeness"), "ord")
    top = labels.withColumn("r", F.row_number().over(w)).where(F.col("r") <= typical)
    top = top.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("r", "ord"))).alias("m"))
    return size.join(top, "cluster").select("cluster", "size", F.col("m.ord").alias("medoids"))


def pairs_within(labels: DataFrame, asked: DataFrame) -> DataFrame:
    """``(ord_a, ord_b)``, smaller first: the asked keys that belong to one cluster."""
    mine = staged(labels.join(asked.select(F.col(asked.columns[0]).alias("ord")).where("ord is not null").distinct(), "ord").select("ord", "cluster"))
    a, b = mine.select(F.col("ord").alias("ord_a"), "cluster"), mine.select(F.col("ord").alias("ord_b"), "cluster")
    return a.join(b, "cluster").where("ord_a < ord_b").select("ord_a", "ord_b")

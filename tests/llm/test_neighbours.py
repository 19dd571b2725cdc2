"""Problem 4 against brute force."""

import tracemalloc

import numpy as np
import pytest

from sparrowlens.llm.neighbours import Forest, _rank, nearest_neighbours, neighbour_pairs

RNG = np.random.default_rng(8)


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r], 0.0, 7) for i, r in enumerate(x)], "chunk_ord long, vec array<double>, norm double, rank int")


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


def test_recall_of_the_forest(spark):
    x = RNG.standard_normal((3000, 16)) + 2 * RNG.standard_normal((30, 16)).repeat(100, 0)
    want = brute(x, 8)
    d = frame(spark, x)
    got = {}
    for r in nearest_neighbours(d, d.select("chunk_ord").where("chunk_ord % 50 = 0"), dim=16, leaf=32).collect():
        got.setdefault(r.ord, {})[r["rank"]] = r.other
    assert set(got) == set(range(0, 3000, 50)) and all(sorted(v) == list(range(1, 9)) for v in got.values())
    assert np.mean([len(set(v.values()) & set(want[i])) / 8 for i, v in got.items()]) > 0.95


@pytest.mark.parametrize("block", [8192, 7])
def test_exact_when_all_leaves_are_visited(spark, block):
    x = RNG.standard_normal((60, 8))
    x[10:14] = x[9]
    d = frame(spark, x).unionByName(frame(spark, x).limit(5))
    got = {}
    for r in sorted(nearest_neighbours(d, dim=8, k=3, leaf=10, reach=99, block=block).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.ord, []).append(r.other)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i, v in got.items():
        s = np.round(u @ u[i], 6)
        s[i] = -2
        assert np.allclose(np.sort(s[v])[::-1], np.sort(s)[::-1][:3], atol=1e-5)
    assert set(got[9]) <= {10, 11, 12, 13} and got[9] == sorted(got[9])


def test_invalid_rows_few_rows_and_pairs(spark):
    d = frame(spark, np.eye(4)[:3])
    bad = [(7, None, None, None), (8, [0.0] * 4, 0.0, 1), (9, [1.0], 1.0, 1), (None, [1.0] * 4, 1.0, 1), (5, [float("nan")] * 4, 1.0, 1)]
    d = d.unionByName(spark.createDataFrame(bad, d.schema))
    asked = spark.createDataFrame([(0,), (0,), (7,), (99,), (None,)], "chunk_ord long")
    near = nearest_neighbours(d, asked, dim=4)
    assert sorted((r.ord, r.other) for r in near.collect()) == [(0, 1), (0, 2)]
    assert neighbour_pairs(nearest_neighbours(d, dim=4)).count() == 3
    assert nearest_neighbours(d.limit(0), dim=4).count() == 0
    assert nearest_neighbours(d, asked.limit(0), dim=4).count() == 0


def keys_of(f, u):
    """The key of every leaf in the shared queue, by walking all of every tree: rows x leaves."""
    out = []
    for t in range(f.trees):
        level = [(0, np.zeros(len(u), np.float32))]
        for _ in range(f.depth):
            below = []
            for node, key in level:
                off = u @ f.axes[t, node] - f.cuts[t, node]
                below += [(2 * node + 1, np.maximum(key, off)), (2 * node + 2, np.maximum(key, -off))]
            level = below
        out += [key for _, key in level]
    return np.array(out).T


def test_the_queue_gives_all_leaves_within_reach():
    f = Forest(RNG.standard_normal((500, 6)).astype(np.float32), trees=3, depth=4)
    u = RNG.standard_normal((20, 6)).astype(np.float32)
    keys, own = keys_of(f, u), f.leaves(u)
    assert keys.shape == (20, 48) and (np.take_along_axis(keys, own, 1) == 0).all() and (f.leaves(u, 2) == own[:, :2]).all()
    reach = np.linspace(0, 2, 20).astype(np.float32) + 1e-3
    row, leaf = f.within(u, reach)
    assert sorted(zip(row.tolist(), leaf.tolist())) == sorted(map(tuple, np.argwhere(keys <= reach[:, None]).tolist()))


@pytest.mark.parametrize("block", [64, 16])
def test_groups_with_many_rows_or_queries_are_divided(spark, block):
    x = RNG.standard_normal((400, 8))
    d = frame(spark, x)
    got = {}
    for r in nearest_neighbours(d, dim=8, k=3, leaf=20, trees=3, reach=99, block=block).collect():
        got.setdefault(r.ord, {})[r["rank"]] = r.other
    want = brute(x, 3)
    assert all([v[1], v[2], v[3]] == list(want[i]) for i, v in got.items()) and len(got) == 400


def test_a_third_of_all_rows_is_one_vector(spark):
    x = RNG.standard_normal((300, 8))
    x[::3] = x[0]
    got = {}
    for r in sorted(nearest_neighbours(frame(spark, x), dim=8, k=3, leaf=30, reach=99).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.ord, []).append(r.other)
    assert len(got) == 300 and all(len(v) == 3 for v in got.values())
    s = np.round((u := x / np.linalg.norm(x, axis=1, keepdims=True)) @ u.T, 6)
    np.fill_diagonal(s, -2)
    for i, v in got.items():
        assert np.allclose(s[i, v], np.sort(s[i])[::-1][:3], atol=1e-5)
        assert i % 3 or v == [j for j in (0, 3, 6, 9) if j != i][:3]


def test_ties_of_a_leaf_fit_in_memory():
    u = np.tile(np.eye(1, 64, dtype=np.float32), (8192, 1))
    tracemalloc.start()
    hits = _rank((np.arange(8192), u), (np.arange(9000, 9512), u[:512], np.full(512, 0.5, np.float32)), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.concatenate([h[1] for h in hits]).tolist() == [0, 1, 2] * 512 and peak < 1 << 30

"""Pooling, search, layout, clustering and orders against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowlens.operators import linear, model
from sparrowlens.operators.check import compare_hits, compare_vectors
from sparrowlens.operators.kmeans import kmeans
from sparrowlens.operators.order import prefix_sum, resample, with_ordinal
from sparrowlens.operators.pooling import _pool_joined, pool
from sparrowlens.operators.search import search, search_one
from sparrowlens.plans.components import connected_components, tree_roots
from sparrowlens.plans.indexing import search_texts, without_axis

RNG = np.random.default_rng(3)


def frame(spark, x, key="id"):
    return spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], f"{key} long, vec array<double>")


def test_pool_weights_and_zeros(spark):
    emb = spark.createDataFrame([(0, [1.0, 0.0], 1.0), (1, [0.0, 1.0], 3.0), (2, [5.0, 5.0], 0.0)], "token_id int, vec array<double>, sif double")
    c = spark.createDataFrame([(1, [0, 1]), (2, [2]), (3, []), (4, None), (5, [0, 99, None]), (6, [0, 0, 1])], "chunk_ord long, token_ids array<int>")
    want = {1: [0.25, 0.75], 2: [0, 0], 3: [0, 0], 4: [0, 0], 5: [1, 0], 6: [0.4, 0.6]}
    for got in (pool(c, emb, 2), _pool_joined(c.select(F.col("chunk_ord").alias("key"), F.col("token_ids").alias("tokens")), emb, 2).withColumnRenamed("key", "chunk_ord")):
        assert {r.chunk_ord: [round(x, 9) for x in r.vec] for r in got.collect()} == want


def test_search_ties_and_bounds(spark):
    x = np.array([[1, 0], [1, 1], [1, 1], [0, 1], [0, 0]], float)
    d = frame(spark, x)
    assert [r.id for r in search_one(d, [1.0, 1.0], 2, key="id").collect()] == [1, 2]
    assert search_one(d, [1.0, 1.0], 99, key="id").count() == 5 and search_one(d, [1.0, 1.0], 0, key="id").count() == 0
    q = d.withColumnRenamed("id", "query_id")
    whole = search(q, d, 3, dim=2, key="id").orderBy("query_id", "rank").collect()
    parts = search(q, d.repartition(3), 3, dim=2, key="id", block_bytes=16).orderBy("query_id", "rank").collect()
    assert whole == parts
    assert [r.id for r in whole if r.query_id == 1] == [1, 2, 0]
    assert [r.score for r in whole if r.query_id == 4] == [0, 0, 0]
    assert search(q, d, 3, dim=7, key="id").count() == 0


def test_batched_search_is_single_search(spark):
    d = frame(spark, RNG.standard_normal((200, 8)))
    b = search(d.where("id < 5").withColumnRenamed("id", "query_id"), d, 8, dim=8, key="id").collect()
    for q in d.where("id < 5").collect():
        one = [(r.id, r.score) for r in search_one(d, q.vec, 8, key="id").collect()]
        assert one == [(r.id, r.score) for r in sorted(b, key=lambda r: r["rank"]) if r.query_id == q.id]
        assert one[0][0] == q.id and abs(one[0][1] - 1) < 1e-12


def test_axes_follow_the_fixed_iteration(spark):
    x = RNG.standard_normal((300, 6)) * np.arange(1, 7)
    c = x - x.mean(0)
    g, axes = c.T @ c, []
    for _ in range(2):
        v = np.sin(np.arange(6) * 12.9898 + 1) * 0.5 + 0.5001
        v /= np.linalg.norm(v)
        for _ in range(60):
            v = g @ v
            for a in axes:
                v -= (v @ a) * a
            v /= np.linalg.norm(v)
        axes.append(v)
    d = frame(spark, x).repartition(4)
    assert np.allclose(linear.top2_axes(d, 6), axes)
    axis = linear.top_component(d, 6)
    assert np.allclose(np.abs(axis), np.abs(np.linalg.svd(x)[2][0]))
    r = without_axis(d, axis, "id").collect()
    assert max(abs(np.dot(x.vec, axis)) for x in r) < 1e-9
    assert linear.column_means(d.limit(0), 6).count() == 0


def test_several_axes_are_removed(spark):
    x = RNG.standard_normal((80, 5)) * np.arange(1, 6)
    d = frame(spark, x)
    axes = linear.top_components(d, 5, 2)
    assert np.allclose(np.abs(axes), np.abs(np.linalg.svd(x)[2][:2]))
    assert max(np.abs(axes @ np.array(r.vec)).max() for r in without_axis(d, axes, "id").collect()) < 1e-9


def test_queries_without_tokens_have_no_hits(spark):
    vocab = spark.createDataFrame([(1, "[UNK]"), (2, "a"), (3, "b")], "token_id int, token string")
    emb = spark.createDataFrame([(2, [1.0, 0.0], 1.0), (3, [0.0, 1.0], 1.0)], "token_id int, vec array<double>, sif double")
    index = frame(spark, [[1, 0], [0, 1]], "chunk_ord")
    asked = spark.createDataFrame([(1, "a"), (2, "  \n"), (3, ""), (4, None), (5, "b b a")], "query_id long, text string")
    got = {(r.query_id, r["rank"]): r.chunk_ord for r in search_texts(asked, vocab, emb, index, 2, dim=2).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (5, 1): 1, (5, 2): 0}


def test_component_of_odd_vectors(spark):
    d = spark.createDataFrame([(1, [1.0, 1.0], "a"), (2, None, None), (3, [1.0], "c"), (4, [0.0, 0.0], "d")], "id long, vec array<double>, x string")
    r = {x.id: x for x in without_axis(d, np.array([1.0, 0.0]), "id", keep=True).collect()}
    assert (r[1].vec, r[1].norm, r[1].x) == ([0.0, 1.0], 1.0, "a")
    assert (r[2].vec, r[2].norm, r[3].vec, r[3].norm) == (None, None, None, None)
    assert (r[4].vec, r[4].norm) == ([0.0, 0.0], 0.0)
    assert without_axis(d.limit(0), np.array([1.0, 0.0]), "id").isEmpty()


def test_codes_of_odd_vectors(spark):
    d = spark.createDataFrame([(1, [1.0, None, float("nan")]), (2, None), (3, [])], "id long, v array<double>")
    r = {x.id: x for x in model.quantize_rows(d, "id", "v").collect()}
    assert set(r) == {1, 3} and list(r[1].codes) == [127, 0, 0] and (r[3].scale, list(r[3].codes)) == (0.0, [])
    e = {x.id: x for x in model.quantize_error(d, "id", "v").collect()}
    assert (e[1].cosine, e[1].max_error, e[3].cosine, e[3].max_error) == (1.0, 0.0, 0.0, 0.0)


def test_coded_tokens_are_what_the_columns_give(spark):
    t = spark.createDataFrame([(i, [float(v) for v in r], 1.0) for i, r in enumerate(np.vstack([RNG.standard_normal((50, 6)), np.zeros((1, 6))]))], "token_id int, vec array<double>, sif double")
    q = model.quantize_rows(t, "token_id", "vec").collect()
    back = {r.token_id: r.vec for r in model.coded_tokens(t, 6).collect()}
    assert all(np.allclose(back[r.token_id], np.array(r.codes) * r.scale) for r in q)


def test_map_and_pick(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 2.0, 1.0), (3, 1.0, 0.5), (4, 1.0, 0.5)], "id long, x double, y double")
    m = {r.id: (r.x, r.y) for r in linear.normalized_map(p).collect()}
    assert m[1] == (-0.85, -0.425) and m[2] == (0.85, 0.425)
    n = linear.normalized_map(p)
    assert linear.pick(n, 0.01, 0, "id").first().id == 3
    assert linear.pick(n, 0.5, 0.5, "id").count() == 0


def brute_kmeans(x, k, rounds):
    k = max(1, min(k, len(x)))
    c = np.array([x[min(i * max(1, len(x) // k), len(x) - 1)] for i in range(k)])
    for _ in range(rounds):
        a = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        for i in range(k):
            if (a == i).any():
                c[i] = x[a == i].mean(0)
    return a


def test_kmeans(spark):
    x = RNG.standard_normal((120, 4))
    for k in (1, 5, 500):
        got = {r.id: r.cluster for r in kmeans(frame(spark, x).repartition(3), 4, k, key="id", rounds=6).collect()}
        assert [got[i] for i in range(120)] == brute_kmeans(x, k, 6).tolist()
    assert kmeans(frame(spark, x).limit(0), 4, 3, key="id").count() == 0


def test_prefix_sums_and_samples(spark):
    d = spark.createDataFrame([(i * 7 % 101, i % 5 if i % 9 else None) for i in range(101)], "o long, n int")
    want, total = {}, 0
    for o, n in sorted((r.o, r.n) for r in d.collect()):
        want[o] = total
        total += n or 0
    assert {r.o: r.before for r in prefix_sum(d, ["o"], "n").collect()} == want
    assert sorted(r.ord for r in with_ordinal(d, ["o"]).collect()) == list(range(101))
    s = resample(with_ordinal(d, ["o"]), "ord", 101, 250).groupBy("o").count().collect()
    assert sum(r["count"] for r in s) == 250 and {r["count"] for r in s} == {2, 3}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 101), (7, 200)] + [(300, 300 + i) for i in range(1, 50)]
    e = spark.createDataFrame([*edges, (None, 5), *edges[:3]], "a long, b long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[200] == 0 and got[101] == 100 and all(got[300 + i] == 300 for i in range(50))
    assert connected_components(e.limit(0)).count() == 0


def test_roots_of_trees(spark):
    parents = [(i, i - 1) for i in range(1, 40)] + [(100 + i, 7) for i in range(30)] + [(201, 200)]
    got = {r.node: r.component for r in tree_roots(spark.createDataFrame(parents, "a long, b long")).collect()}
    assert got == {a: 200 if a == 201 else 0 for a, _ in parents}
    assert tree_roots(spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError, match="cycle"):
        tree_roots(spark.createDataFrame([(1, 2), (2, 1)], "a long, b long"), rounds=3)


def test_checks(spark):
    a = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.8)], "query_id int, id int, score double")
    b = spark.createDataFrame([(0, 1, 0.85), (0, 3, 0.8)], "query_id int, id int, score double")
    r = compare_hits(a, b, "id").first()
    assert r.overlap == 0.5 and abs(r.max_delta - 0.05) < 1e-9
    v = frame(spark, [[1, 0], [0, 0]])
    assert compare_vectors(v, v, "id").first().min_cosine == 1.0
    assert compare_vectors(v.limit(0), v, "id").first().mean_cosine == 1.0

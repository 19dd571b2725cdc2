"""Problem 1 against planted clusters."""

import numpy as np

from sparrowlens.llm import clusters, vectors
from sparrowlens.llm.clusters import describe_clusters, local_clusters, pairs_within, similarity_clusters

RNG = np.random.default_rng(5)


def planted(dim=16, sizes=(40, 25, 12, 6), noise=20, spread=(0.12, 0.2, 0.1, 0.05)):
    centres = np.linalg.qr(RNG.standard_normal((dim, dim)))[0][: len(sizes)]
    x, y = [], []
    for c, (m, s) in enumerate(zip(sizes, spread)):
        x += list((centres[c] + s * RNG.standard_normal((m, dim))) * RNG.uniform(0.3, 3, (m, 1)))
        y += [c] * m
    lone = np.linalg.qr(RNG.standard_normal((dim, dim)))[0]
    x += list(lone[: min(noise, dim - len(sizes))])
    y += [-1] * min(noise, dim - len(sizes))
    return np.array(x), np.array(y)


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in r], 1.0, "x") for i, r in enumerate(x)], "chunk_ord long, vec array<double>, norm double, cluster string")


def agreement(got, y):
    same = lambda a: a[:, None] == a[None, :]
    g = np.array([got.get(i, -1 - i) for i in range(len(y))])
    t = np.where(y < 0, -1 - np.arange(len(y)), y)
    a, b = same(g), same(t)
    return (a & b).sum() / a.sum(), (a & b).sum() / b.sum()


def test_local_clusters_find_planted_ones():
    x, y = planted()
    label, core = local_clusters((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))
    p, r = agreement({i: int(v) for i, v in enumerate(label) if v >= 0}, y)
    assert p > 0.97 and r > 0.9
    assert local_clusters(np.zeros((0, 4), np.float32))[0].size == 0
    assert (local_clusters(np.eye(4, dtype=np.float32))[0] == -1).all()


def test_operator_with_bad_rows_copies_and_small_cells(spark):
    x, y = planted(sizes=(90, 60, 30, 10))
    n = len(x)
    bad = [(n, None), (n + 1, [0.0] * 16), (n + 2, [1.0] * 3), (n + 3, [float("nan")] * 16), (None, [1.0] * 16), (n + 4, [1.0] * 15 + [None]), (n + 5, [float("inf")] + [0.0] * 15)]
    same = [(n + 10 + i, [float(v) for v in (1.0, *[0.0] * 14, -1.0)]) for i in range(40)]
    d = frame(spark, x)
    d = d.unionByName(spark.createDataFrame([(*b, None, None) for b in bad + same], d.schema)).unionByName(d.limit(20))
    for options in ({}, {"target": 40, "limit": 90}):
        lab = similarity_clusters(d, dim=16, **options)
        got = {r.ord: r.cluster for r in lab.collect()}
        assert lab.count() == len(got)
        p, r = agreement(got, y)
        assert p > 0.97 and r > (0.8 if options else 0.9), options  # cells of 40 rows see little of a cluster
        assert len({got[n + 10 + i] for i in range(40)}) == 1
        assert not set(got) & {n + i for i in range(6)}
    about = {r.cluster: (r.size, r.medoids) for r in describe_clusters(lab).collect()}
    size, medoids = about[got[n + 10]]
    assert size >= 40 and medoids == sorted(medoids) and set(medoids) <= {n + 10 + i for i in range(40)}
    probes = spark.createDataFrame([(n + 11, 1), (n + 12, 1), (n + 11, 1), (None, 1), (n, 1)], "chunk_ord long, ord_a int").select("chunk_ord")
    assert [tuple(r) for r in pairs_within(lab, probes).collect()] == [(n + 11, n + 12)]


def test_empty_tables(spark):
    d = frame(spark, np.zeros((1, 16)))
    assert similarity_clusters(d, dim=16).count() == 0
    assert similarity_clusters(d.limit(0), dim=16).count() == 0
    assert describe_clusters(similarity_clusters(d, dim=16)).count() == 0


def test_inseparable_rows_are_cut_by_hash_and_joined_again(spark):
    x = np.zeros((600, 16))
    x[:, 0] = 1
    x[:, 1] = np.linspace(0, 1e-5, 600)
    got = {r.ord: r.cluster for r in similarity_clusters(frame(spark, x), dim=16, target=100, limit=200).collect()}
    assert len(got) == 600 and len(set(got.values())) == 1


def test_density_and_the_row_followed(monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 7)
    u = clusters._normed(RNG.standard_normal((60, 3)))
    s = u @ u.T
    np.fill_diagonal(s, -2)
    rho = clusters._density(u, 2)
    assert np.allclose(rho, -np.sort(-s, 1)[:, 1], atol=1e-6)
    up = clusters._followed(u, rho, 0.5)
    for i in range(60):
        denser = np.nonzero((rho > rho[i]) | ((rho == rho[i]) & (np.arange(60) < i)))[0]
        best = denser[s[i, denser].argmax()] if len(denser) else i
        assert up[i] == best or (up[i] == i and s[i, best] < 0.5 + 1e-6) or abs(s[i, up[i]] - s[i, best]) < 1e-6
    assert (clusters._density(u[:2], 2) == -2).all()


def test_members_that_meet_in_no_cell_are_found(spark, monkeypatch):
    # clusters of 4 among twice as many pivots, each row in one cell only: hardly any cell holds three members
    monkeypatch.setattr(clusters, "SENT", 150)
    x = np.linalg.qr(RNG.standard_normal((48, 48)))[0].repeat(4, 0) + 0.05 * RNG.standard_normal((192, 48))
    got = {r.ord: r.cluster for r in similarity_clusters(frame(spark, x), dim=48, target=2, limit=200, overlap=1).collect()}
    p, r = agreement(got, np.arange(192) // 4)
    assert p > 0.97 and r > 0.97


def test_closest_sees_all_centroids_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(clusters, "SENT", 20)
    u, c = clusters._normed(RNG.standard_normal((50, 8))), clusters._normed(RNG.standard_normal((90, 8)))
    rows = lambda m: spark.createDataFrame([(i, 1 + i % 3, [float(v) for v in r]) for i, r in enumerate(m)], "rep long, w long, unit array<float>")
    got = {r.rep: r.other for r in clusters._closest(rows(u), rows(c), 8, least=0.5).collect()}
    s = u @ c.T
    assert got == {i: int(s[i].argmax()) if s[i].max() >= 0.5 else None for i in range(50)}
    t = c @ c.T
    np.fill_diagonal(t, -2)
    # weights 1, 2, 3 in turn: further copies are neighbours too
    found = clusters._densities(rows(c), 8, 2)
    rho = {r.rep: r.rho for r in found.collect()}
    for i in range(90):
        near = sorted([1.0] * (i % 3) + [t[i, j] for j in range(90) if j != i for _ in range(1 + j % 3)], reverse=True)
        assert abs(rho[i] - near[1]) < 1e-5
    up = {r.a: r.b for r in clusters._uphill(found, 8, 0.5).collect()}
    for i in range(90):
        denser = [j for j in range(90) if (rho[j], -j) > (rho[i], -i) and t[i, j] >= 0.5]
        assert (i in up) == bool(denser) and (not denser or up[i] == max(denser, key=lambda j: t[i, j]))


def test_a_row_follows_what_is_near_and_sums_need_no_order():
    u = clusters._normed(RNG.standard_normal((3000, 6)))
    near = np.full((3000, 2), -1)
    rho = clusters._density(u, 2, near)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert (near == np.argsort(-s, 1, kind="stable")[:, :2]).mean() > 0.999
    assert np.allclose(rho, -np.partition(-s, 1)[:, 1], atol=1e-6)
    assert (clusters._followed(u, rho, 0.5, near) == clusters._followed(u, rho, 0.5)).mean() > 0.999
    group = RNG.integers(0, 40, 3000)
    assert np.allclose(clusters._summed(u, group, 41), [u[group == g].astype(float).sum(0) for g in range(41)])


def test_products_stay_in_tiles(monkeypatch):
    # 4096 rows against themselves took products of 1024 x 4096, more than the cache of a core holds
    largest = []
    real = np.matmul
    monkeypatch.setattr(np, "matmul", lambda a, b, out: largest.append(out.size) or real(a, b, out=out))
    u = clusters._normed(RNG.standard_normal((4096, 8)))
    clusters._followed(u, clusters._density(u, 2), 0.5)
    assert largest and max(largest) <= clusters.TILE * clusters.BLOCK


def test_messages_are_held_together_and_few_rows_use_all_cores(spark, monkeypatch):
    # a table was written for each message, and rows of one file were one task
    monkeypatch.setattr(clusters, "SENT", 20)
    monkeypatch.setattr(clusters, "BLOCK", 8)
    written, real = [], clusters.staged
    monkeypatch.setattr(clusters, "staged", lambda d: written.append(d.rdd.getNumPartitions()) or real(d))
    rows = spark.createDataFrame([(i, 1, [float(v) for v in r]) for i, r in enumerate(clusters._normed(RNG.standard_normal((90, 8))))], "rep long, w long, unit array<float>").coalesce(1)
    assert clusters._densities(rows, 8, 2).count() == 90
    assert len(written) == 2 and written[0] >= 4


def test_centroids_of_sums_in_any_number_of_batches(spark, monkeypatch):
    # every sum became a row for each dimension; sums that cancel out had no centroid and ended the query
    x = RNG.standard_normal((500, 4))
    local = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(500, [1.0, 0.0, 0.0, 0.0], 1), (501, [-1.0, 0.0, 0.0, 0.0], 1)], "local long, total array<double>, n long")
    comp = spark.createDataFrame([(i, i % 7) for i in range(500)] + [(500, 500), (501, 500)], "local long, component long")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = {r.component: (r.centre, r.n) for r in clusters._centres(local, comp, 4).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == 8 and got[500] == ([0.0] * 4, 2)
    for g in range(7):
        total = x[np.arange(500) % 7 == g].sum(0)
        assert np.allclose(got[g][0], total / np.linalg.norm(total)) and got[g][1] == sum(i % 7 == g for i in range(500))


def test_equal_vectors_find_their_cluster_by_hash_or_by_vector(spark, monkeypatch):
    x, _ = planted()
    d = frame(spark, np.repeat(x, 3, axis=0))
    want = {(r.ord, r.cluster) for r in similarity_clusters(d, dim=16).collect()}
    monkeypatch.setattr(clusters, "_told_apart", lambda same: False)
    assert want and {(r.ord, r.cluster) for r in similarity_clusters(d, dim=16).collect()} == want


def test_vectors_pass_as_bytes(spark):
    # lists of 64 numbers were copied number by number in every pass
    x = RNG.standard_normal((20, 4))
    d = frame(spark, x).unionByName(frame(spark, x[:5] * 2)).unionByName(frame(spark, -x[5:7], 5))
    lists = {r.ord: r.unit for r in vectors.unit_vectors(d, 4).collect()}
    packed = vectors.unit_vectors(d, 4, packed=True)
    got = packed.toArrow()
    assert packed.count() == len(lists) == 20 and packed.schema["unit"].dataType.simpleString() == "binary"
    units = vectors.matrix(got.column("unit").combine_chunks(), 4)
    assert {int(k): [float(v) for v in r] for k, r in zip(got.column("ord").to_pylist(), units)} == lists
    part = vectors.as_bytes(units).slice(3, 6)
    assert np.array_equal(vectors.matrix(part, 4), units[3:9]) and vectors.matrix(part[:0], 4).shape == (0, 4)

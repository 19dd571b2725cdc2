"""Problem 3 against counting in Python."""

from collections import Counter

import pytest

from sparrowlens.llm.frequencies import marked, term_frequencies


def test_counts_with_deep_radix(spark):
    rows = [(i, [i % 7, i % 3, 5, 5, None] if i % 4 else []) for i in range(200)] + [(900, None), (None, [5]), (None, [5]), (None, [6])]
    d = spark.createDataFrame([(*r, "x") for r in rows] + [(3, rows[3][1], "x")], "chunk_ord long, token_ids array<int>, records string").repartition(5)
    occ, rec = Counter({5: 1, 6: 1}), Counter({5: 1, 6: 1})
    for k, t in rows[:200]:
        t = [x for x in t if x is not None]
        occ.update(t)
        rec.update(set(t))
    for limit in (10**6, 2):
        got = term_frequencies(d, limit=limit).collect()
        assert {r.term: (r.occurrences, r.records) for r in got} == {t: (occ[t], rec[t]) for t in occ}, limit
        assert len(got) == len(occ)
    m = {r.term: r["mark"] for r in marked(term_frequencies(d), 200, rare_below=30).collect()}
    assert m[5] == "common" and m[6] == "rare" and m[1] is None
    assert term_frequencies(d.limit(0)).count() == 0


def test_one_hot_term_ends(spark):
    d = spark.range(0, 3000, 1, 30).selectExpr("id as chunk_ord", "if(id % 300 = 0, array(7, cast(id as int) + 100), array(7)) as token_ids")
    # 30 tasks bring a count each of the one term, which no division can make fewer
    got = {r.term: (r.occurrences, r.records) for r in term_frequencies(d, limit=5).collect()}
    assert got.pop(7) == (3000, 3000) and got == {i + 100: (1, 1) for i in range(0, 3000, 300)}


def test_tasks_spill_beyond_the_terms_they_hold(spark, monkeypatch):
    from sparrowlens.llm import frequencies

    monkeypatch.setattr(frequencies, "HELD", 50)
    d = spark.range(0, 500, 1, 2).selectExpr("id as chunk_ord", "array(cast(id % 90 as int), cast(id as int)) as token_ids")
    got = {r.term: r.occurrences for r in term_frequencies(d).collect()}
    assert got == Counter([i % 90 for i in range(500)] + list(range(500)))


@pytest.mark.parametrize("name", ["p3_found", "p3_terms"])
def test_same_as_sql(spark, sf_dir, name):
    import duckdb

    from sparrowlens.llm import queries

    con = duckdb.connect()
    con.sql(f"create view chunks as select * from '{sf_dir}/chunks.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).fetchall()
    got = queries.QUERIES[name](spark, sf_dir)
    columns = con.sql(queries.ORACLE_SQL[name]).columns
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))

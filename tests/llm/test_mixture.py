"""Problem 7: shares, caps, and what may not enter."""

from collections import Counter

import pytest

from sparrowlens.llm.mixture import mixture, shares, source_name


def corpus(spark):
    rows = [(i, f"word{i} " * (1 + i % 13), "big") for i in range(400)] + [(1000 + i, f"tiny text {i} " * 3, " Small-Source") for i in range(40)] + [(2000 + i, f"mid {i} " * 5, "MID") for i in range(120)]
    rows += [(3000, "word1 " * 2, "big"), (3001, "word1 " * 2, "mid"), (3002, None, "big"), (3003, "", "big"), (3004, "lost", "other"), (3005, "lost", None), (None, "no id", "big"), rows[5]]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, copies int")


def targets(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, weight double, max_repeat int")


def test_every_source_holds_its_share(spark):
    t = targets(spark, ("big", 0.5, 1), ("small_source", 0.2, 4), ("mid", 0.3, 2))
    m = mixture(corpus(spark), t)
    rows = m.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and not {r.doc_id for r in rows} & {None, 3001, 3002, 3003, 3004, 3005}
    limit = {"big": 1, "small_source": 4, "mid": 2}
    assert all(1 <= r.copies <= limit[r.source] for r in rows)
    got = {r.source: r for r in shares(m, t).collect()}
    for s, w in (("big", 0.5), ("small_source", 0.2), ("mid", 0.3)):
        assert got[s].share == pytest.approx(w, abs=0.01)
    size = Counter()
    for r in rows:
        size[r.source] += r.tokens * r.copies
    assert {s: r.tokens for s, r in got.items()} == size
    assert sorted(map(tuple, mixture(corpus(spark).repartition(7), t).collect())) == sorted(map(tuple, rows))


def test_one_text_is_one_text(spark):
    t = targets(spark, ("big", 1.0, 1))
    texts = Counter()
    of = {r.doc_id: r.text for r in corpus(spark).collect()}
    for r in mixture(corpus(spark), t).collect():
        texts[of[r.doc_id]] += r.copies
    assert max(texts.values()) == 1


def test_totals_missing_sources_and_caps(spark):
    t = targets(spark, ("big", 0.5, 1), ("nowhere", 0.25, 3), ("mid", 0.25, None), ("zero", 0.0, 1), (None, 0.3, 1))
    m = mixture(corpus(spark), t, total=900)
    got = {r.source: r for r in shares(m, t).collect()}
    assert got["nowhere"].tokens == 0 and got["big"].tokens == pytest.approx(600, abs=40) and got["mid"].tokens == pytest.approx(300, abs=20)
    most = {r.source: r for r in shares(mixture(corpus(spark), t, total=10**9), t).collect()}
    assert most["big"].most_copies == 1 and most["mid"].most_copies == 1
    assert mixture(corpus(spark).limit(0), t).count() == 0 and mixture(corpus(spark), t.limit(0)).count() == 0
    assert shares(mixture(corpus(spark).limit(0), t), t).where("share > 0").count() == 0


def test_source_names(spark):
    d = spark.createDataFrame([("  Chat-Log ",), ("CHAT_LOG",), ("chat log",)], "s string")
    assert {r[0] for r in d.select(source_name(d.s)).collect()} == {"chat_log"}

"""Problem 5: layouts of one record, and records that only look alike."""

import pytest

from sparrowlens.llm import copies as module
from sparrowlens.llm.copies import collapsed, copies, hashed_records, hashed_texts, merkle, normal, record


def found(spark, texts):
    d = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "chunk_ord long, text string, leaf string")
    return {(r.first_id, r.copy_id) for r in copies(hashed_texts(d, "chunk_ord", "text")).collect()}


SAME = [
    "title: red fox\nserial: k9\ncolour: blue",
    '{"serial": "k9", "colour": "blue", "title": "red  fox"}',
    "COLOUR = Blue; TITLE = Red fox; SERIAL = K9.",
    " serial:　k9  | title: red\nfox | colour: blue ",
    "serial: k9 title: red fox colour: blue",
]


def test_fields_in_every_notation():
    assert len({merkle(record(t)) for t in SAME}) == 1
    assert record("no list here") is None and record("just: one") is None
    nested = ("fields", (("a", ("fields", (("x", "150"), ("y", ("list", ("1", "2")))))), ("b", "null")))
    assert record('{"a": {"x": 1.50, "y": [1, 2]}, "b": null}') == nested
    assert merkle(record('{"a": 1, "b": 2} and more words')) != merkle(record('{"a": 1, "b": 2}'))


def test_nested_records_are_unordered_at_every_depth():
    same = ['{"a": {"x": 1, "y": {"p": "q r", "s": 2}}, "b": [1, 2]}', '{"B": [1, 2], "A": {"y": {"s": 2, "p": "Q-R"}, "x": 1}}']
    assert len({merkle(record(t)) for t in same}) == 1
    other = ['{"a": {"x": 1, "y": {"p": "q r", "s": 2}}, "b": [2, 1]}', '{"a": {"x": 1, "s": 2, "y": {"p": "q r"}}, "b": [1, 2]}', '{"a": 1, "a": 2}', '{"a": 2}']
    assert len({merkle(record(t)) for t in [same[0], *other]}) == 5
    assert merkle(record('{"a":1,"a":2}')) == merkle(record('{"a": 2, "a": 1}'))


def test_names_of_any_length_but_no_times_or_links():
    long = "a name of forty and more characters in nine words"
    texts = [f"date of birth: x | {long}: y", f"{long} = Y\nDate of Birth = X"]
    assert len({merkle(record(t)) for t in texts}) == 1 and record(texts[0])
    assert record("we met at 10:22\nand left at 11:30") is None and record("see http://x.example\nand https://y.example") is None


def test_a_text_of_two_readings_ties_both(spark):
    assert found(spark, ["ab: c | d: e", "a: bc | d: e", "d: e | a: bc", "d: e | ab: c", "x: y | z: w"]) == {(0, 1), (0, 2), (0, 3)}
    d = spark.createDataFrame([(i, t, tab) for tab in ("s", "t") for i, t in enumerate(["ab: c | d: e", "a: bc | d: e", "d: e | a: bc"])], "k long, t string, tab string")
    rec = hashed_texts(d.where("tab = 's'"), "k", "t").selectExpr("*", "'s' tab").unionByName(hashed_texts(d.where("tab = 't' and k <> 1"), "k", "t").selectExpr("*", "'t' tab"))
    assert {tuple(r) for r in copies(rec, ("tab",)).collect()} == {("s", 0, 1), ("s", 0, 2)}


def test_lists_and_texts(spark):
    swapped = "title: blue\nserial: k9\ncolour: red fox"
    extra = "title: red fox b\nserial: k9\ncolour: blue"
    prose = ["The fox, it runs.", "* the FOX\tit runs", "the it fox runs", "", None, " .!", " ?!"]
    got = found(spark, [*SAME, swapped, extra, *prose, prose[0]])
    assert got == {(0, i) for i in range(1, 5)} | {(7, 8), (7, 14)}


def test_unreadable_layout_is_tied_by_its_letters(spark):
    assert found(spark, ["b: two; a: one", "a: one; b: two", "b two a one"]) == {(0, 1), (0, 2)}


def test_repeats_nulls_empties_and_groups(spark):
    d = spark.createDataFrame([(5, "x y"), (5, "x y"), (2, "X-Y"), (None, "xy"), (9, "q")], "k long, t string")
    c = copies(hashed_texts(d, "k", "t"))
    assert [tuple(r) for r in c.collect()] == [(2, 5)]
    assert [tuple(r) for r in collapsed(c).collect()] == [(2, 2)]
    assert copies(hashed_texts(d.limit(0), "k", "t")).count() == 0
    r = spark.createDataFrame([(1, "AB-c", "n_1"), (2, "abc", "N 1"), (3, "abc", None), (4, "abc", "--"), (5, "ab", "cn1")], "meta_id long, h string, n string")
    assert [tuple(x) for x in copies(hashed_records(r, "meta_id", ["h", "n"])).collect()] == [(1, 2)]


def test_hot_group(spark):
    d = spark.range(3000).selectExpr("id as k", "if(id % 3 = 0, 'Hot, text', concat('t', id)) as t")
    assert copies(hashed_texts(d, "k", "t")).where("first_id = 0").count() == 999


def test_forms_are_compared_where_digests_clash(spark, monkeypatch):
    d = spark.createDataFrame([(1, "aa"), (2, "A A"), (3, "bb"), (4, "B.B")], "k long, t string")
    rec = hashed_texts(d, "k", "t")
    from pyspark.sql import functions as F

    clashing = rec.withColumn("leaf", F.lit(b"same"))
    assert {tuple(r) for r in copies(clashing).collect()} == {(1, 2), (3, 4)}
    assert module.SALTS > 1


@pytest.mark.parametrize(("a", "b"), [("Straße", "STRASSE"), ("É-1", "é1"), ("a_b", "AB")])
def test_normal(a, b):
    assert normal(a) == normal(b)

"""Problem 8: items in made-up texts, held-out names, placeholders."""

import numpy as np
import pytest

from sparrowlens.llm.privacy import FEATURES, Lexicon, Model, candidates, described, fit, personal_items, redacted, redacted_text, weak_label

GIVEN = ["Alda", "Bruno", "Célie", "Dorte", "Enzo", "Freya"]
COMMON = "the a baker young oakholt redwick stoneholt call order met we house frau herr street for to from thanks write contact please meeting of and is was ticket number road hello".split()
FAMILIES = ["Marholt", "Serholt", "Dunwick", "Velwick", "Torholt", "Pelwick", "Garholt", "Linwick"]
ITEMS = {
    "email": ["a.b+c@mail.example.org", "jo_1 [at] post [dot] test", "x(at)y.example", "UP@CASE.TEST"],
    "phone": ["+44 7700 900123", "(212) 555-0147", "06.39.98.62.64", "+49 (0)171/3920041", "(+34) 555010612", "0049 30 23125 066", "01632 960026", "12125550147", "555 010 565", "+1 646 555 0119"],
    "id_number": ["000-12-3456", "QQ 12 34 56 C", "QQ123456C", "3 54 13 99 026 631 89", "T22395354D", "00035485A", "00.013.508-Z", "X0043796B", "00 026 926 006"],
    "address": ["12 Marble Street", "Flat 3, 4 Old Mill Lane, 12345 Newton", "Lindenstraße 12a", "Am Hofplatz 7, 10115 Berlin", "34 bis, rue de la Paix", "Calle Mayor 5", "C/ Luna, 12, 2º B"],
}


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(4)
    texts = []
    for i in range(240):
        kind = list(ITEMS)[i % 4]
        item = ITEMS[kind][i % len(ITEMS[kind])]
        family = FAMILIES[i % 8]
        name = (f"{GIVEN[i % 6]} {family}", f"{family}, {GIVEN[i % 6]}", f"{GIVEN[i % 6]} K. {family}")[i % 3]
        other = ("Order 00012345678", "Range 100-200-3000", "ISBN 978-0-00-000000-2", "at 192.0.2.14", "10000000000000000000000000001", "Build 20310415-0032")[i % 6]
        intro = ("We met ", "", "Dr. ", "Hello ")[i // 3 % 4]
        texts.append(f"{intro}{name}{', who came' if i % 5 == 0 else ''} for the meeting. Contact: {item} thanks. {other} of The {rng.choice(['Krendall', 'Obsidian', 'Quarry'])} House. Ticket {other.split()[-1]}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocab = spark.createDataFrame([(w,) for w in COMMON], "token string")
    given = spark.createDataFrame([(g,) for g in GIVEN], "given_name string")
    return fit(docs, vocab, given, trees=8, depth=3)


@pytest.mark.parametrize(("kind", "item"), [(k, x) for k, v in ITEMS.items() for x in v])
def test_formats(spark, model, kind, item):
    text = f"Please contact ({item}) for the meeting."
    assert any(s.kind == kind and s.start == text.index(item) for s in candidates(text))
    got = personal_items(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert (kind, text.index(item)) in {(r.kind, r.char_start) for r in got}


def test_names_known_and_new(spark, model):
    texts = ["Thanks to Bruno Marholt and Zerina Velwick for the meeting", "Dr. Dunwick, Alda is of the house", "We met ENZO TORHOLT", "write to F. Garholt please", "The Order was of the House", ""]
    d = spark.createDataFrame([*enumerate(texts), (99, None), (0, texts[0])], "doc_id long, text string")
    got = {(r.doc_id, texts[r.doc_id][r.char_start : r.char_end]) for r in personal_items(d, model).where("kind = 'name'").collect()}
    assert {(0, "Bruno Marholt"), (1, "Dunwick, Alda"), (2, "ENZO TORHOLT"), (3, "F. Garholt")} <= got
    assert (0, "Zerina Velwick") in got and not {i for i, _ in got} & {4, 5}


def test_common_words_and_titles_are_proposed(model):
    for text, name in (("We met Emma Baker today", "Emma Baker"), ("with Don Velwick there", "Don Velwick"), ("Alda Baker came", "Alda Baker"), ("reach 555-0147 now", "555-0147")):
        assert any(text[s.start : s.end] == name for s in candidates(text))
    lex = model.lexicon
    label = lambda t: {t[s.start : s.end]: weak_label(s, described(t, s, lex), lex) for s in candidates(t)}
    assert label("Dr. Alda Baker came")["Alda Baker"] == 1 and label("x Alda Baker came")["Alda Baker"] is None
    assert label("met Dr Baker")["Dr Baker"] == 0 and label("the The House")["The House"] == 0


@pytest.mark.parametrize(("families", "least"), [(("Oakholt", "Redwick", "Stoneholt"), 12), (("Baker", "Young", "Smith"), 0)])
def test_held_out_families_that_are_common_words(spark, model, families, least):
    # neither the given names nor these families stood in the texts of the fit; the endings of
    # the second group were never seen either, which the trees do not take for names (README)
    people = [f"{g} {f}" for g in ("Emmo", "Torben", "Zerina", "Marla") for f in families]
    texts = [f"Dr. {p} for the meeting." if i % 2 else f"We met {p} for the meeting." for i, p in enumerate(people)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, texts[r.doc_id][r.char_start : r.char_end]) for r in personal_items(d, model).where("kind = 'name'").collect()}
    assert len(got & set(enumerate(people))) >= least


def test_other_numbers_stay(spark, model):
    text = "Order 00012345678. Range 100-200-3000. 192.0.2.14 at 10:22:31. ISBN 978-0-00-000000-2. 10000000000000000000000000001 @scope/x"
    assert personal_items(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).count() == 0


def test_placeholders(spark, model):
    d = spark.createDataFrame([(1, "Hello Alda Marholt, call +44 7700 900123!"), (2, None), (3, ""), (4, "nothing")], "doc_id long, text string").withColumn("items", __import__("pyspark").sql.functions.lit(5))
    r = {x.doc_id: (x.items, x.text) for x in redacted(d, model).collect()}
    assert r == {1: (2, "Hello [NAME], call [PHONE]!"), 2: (0, None), 3: (0, ""), 4: (0, "nothing")}
    assert redacted_text("abc", []) == "abc"
    assert redacted(d.limit(0), model).count() == 0 and personal_items(d.limit(0), model).count() == 0


def test_without_labels_formats_decide(spark):
    m = fit(spark.createDataFrame([], "doc_id long, text string"), None, None)
    assert m.trees == []
    got = personal_items(spark.createDataFrame([(1, "mail a@b.test")], "doc_id long, text string"), m).collect()
    assert [(r.kind, r.char_start) for r in got] == [("email", 5)]


def test_features_have_names():
    s = candidates("Call (212) 555-0147 now, Bruno Marholt")
    lex = Lexicon(frozenset(), frozenset())
    assert {len(described("Call (212) 555-0147 now, Bruno Marholt", x, lex)) for x in s} == {len(FEATURES)}
    assert isinstance(Model([], lex, {}), Model)

"""Words, pieces, windows and marks."""

import pytest
from pyspark.sql import functions as F

from sparrowlens.functions import bytes_label, escape_html, extension, highlight, pretokens, preview
from sparrowlens.operators.tokenize import WordPiece, split_words, tokenize
from sparrowlens.operators.windows import window_starts, windows

VOCAB = ["[PAD]", "[UNK]", "un", "##able", "##ab", "##le", "a", "##a", "##b", "token", "##s", "ab", "abc", "##cd", "!"]
IDS = {t: i for i, t in enumerate(VOCAB)}


@pytest.mark.parametrize(
    ("word", "pieces"),
    [("tokens", ["token", "##s"]), ("unable", ["un", "##able"]), ("unabs", ["un", "##ab", "##s"]), ("xyz", ["[UNK]"]), ("unz", ["[UNK]"]), ("abcd", ["[UNK]"]), ("a" * 100, ["a"] + ["##a"] * 99), ("a" * 101, ["[UNK]"])],
)
def test_wordpiece(word, pieces):
    assert WordPiece(IDS, 1).split(word) == [IDS[p] for p in pieces]


def vocab(spark):
    return spark.createDataFrame([(i, t) for t, i in IDS.items()], "token_id int, token string")


def test_tokenize_spans_and_nulls(spark):
    docs = spark.createDataFrame([(1, "Tokens  un!", 9), (2, "", 9), (3, None, 9), (4, "ﬁ AB", 9)], "doc_id int, text string, token_ids int")
    r = {x.doc_id: x for x in tokenize(docs, vocab(spark)).collect()}
    assert r[1].token_ids == [9, 10, 2, 14] and r[1].tok_start == [0, 0, 8, 10] and r[1].tok_end == [6, 6, 10, 11]
    assert r[2].token_ids == [] and r[3].token_ids is None
    assert r[4].text == "fi AB" and r[4].token_ids == [1, 11] and r[4].tok_start == [0, 3]
    assert tokenize(docs.limit(0), vocab(spark)).count() == 0


def test_words_agree_between_engines(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    wp = WordPiece(IDS, 1)
    for r in docs.select("text", pretokens(F.col("text")).alias("w")).collect():
        assert [m.group() for m in wp.words.finditer(r.text.lower())] == r.w


def test_split_words(spark):
    d = spark.createDataFrame([("tokens",), ("tokens",), (None,), ("zz",)], "word string")
    assert {r.word: r.pieces for r in split_words(d, vocab(spark)).collect()} == {"tokens": [9, 10], "zz": [1]}


@pytest.mark.parametrize(("n", "count"), [(None, 0), (0, 0), (1, 1), (128, 1), (129, 2), (224, 2), (225, 3), (320, 3), (321, 4)])
def test_window_counts(spark, n, count):
    starts = spark.createDataFrame([(n,)], "n int").select(window_starts(F.col("n"))).first()[0]
    assert starts == [96 * i for i in range(count)]


def test_windows_reproduce_text(spark):
    t = tokenize(spark.createDataFrame([("d", "token ab un ab token!")], "doc_name string, text string"), vocab(spark))
    w = windows(t, size=3, overlap=1).orderBy("start").collect()
    assert [x.chunk_text for x in w] == ["token ab un", "un ab token", "token!"]
    assert [x.chunk_id for x in w] == ["d#0", "d#2", "d#4"]
    assert [x.start for x in windows(t, size=2, overlap=5).orderBy("start").collect()] == [0, 1, 2, 3, 4]


def test_marks_and_labels(spark):
    d = spark.createDataFrame([("a GPU & gpu", 221 * "x", 1536.0, "A.B.Md")], "t string, long string, n double, f string")
    r = d.select(highlight(F.col("t"), "gpu x").alias("h"), escape_html(F.lit("<&>\"'")).alias("e"), preview(F.col("long")).alias("p"), bytes_label(F.col("n")).alias("b"), extension(F.col("f")).alias("x"), highlight(F.col("t"), "x").alias("n")).first()
    assert r.h == "a <mark>GPU</mark> &amp; <mark>gpu</mark>"
    assert r.e == "&lt;&amp;&gt;&quot;&#39;" and r.p == 220 * "x" + "…" and r.b == "1.5 KB" and r.x == "md" and r.n == "a GPU &amp; gpu"

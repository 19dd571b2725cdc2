"""Problem 2 against a plain restatement of the rule."""

import re

import numpy as np
import pytest

from sparrowlens.llm.pieces import cut_points, cuts, paragraph_ends, sentence_ends, split_items


def tokens(text):
    at = [m.span() for m in re.finditer(r"\w+|[^\w\s]", text)]
    return [7] * len(at), [a for a, _ in at], [b for _, b in at]


@pytest.mark.parametrize(
    ("text", "ends"),
    [
        ("One. Two! Three?! Four... five", [4, 9, 17, 25]),
        ('He said "no." Then (yes!) left', [13, 25]),
        ("See fig. 3, e.g. this. P. ex. ici. Z. B. das. Approx. ten", [22, 34, 45]),
        ("Dr. B. Smith vs. C. Jones. Done", [26]),
        ("line break\nis no end. 3.14 is one", [21]),
        ("ends.\nNext", [5]),
        ("«Oui.» «Non.» fin", [6, 13]),
        ("", []),
    ],
)
def test_sentence_ends(text, ends):
    assert sentence_ends(text) == ends


def test_paragraph_ends():
    assert paragraph_ends("a\n\nb\r\n \t\r\nc\nd\r\ne") == [1, 4]
    assert paragraph_ends("a\r\nb") == []
    assert paragraph_ends("a\r\rb") == [1]


def test_cuts_follow_the_hierarchy():
    text = "aa bb cc. dd ee ff gg hh\n\nii jj kk ll mm nn oo pp qq rr ss tt"
    _, s, e = tokens(text)
    n = len(s)
    s, e = np.array(s), np.array(e)
    assert cuts(n, text, s, e, 12, 2)[0] == 9  # the paragraph
    assert cuts(n, text, s, e, 7, 2)[0] == 4  # no paragraph fits, the sentence does
    assert cuts(n, text, s, e, 3, 1)[:2] == [3, 4]  # words, then the sentence end
    assert cuts(n, text, s, e, n, 2) == []
    assert cuts(10, None, None, None, 4, 1) == [4, 7]
    assert cuts(10, "x" * 10, np.zeros(10, int), np.full(10, 10), 4, 1) == [4, 7]  # one word of many pieces
    assert cuts(6, None, None, None, 2, 9) == [2, 3, 4, 5]  # overlap is held below the window


def test_invariants_on_the_table(spark, sf_dir):
    items = {r.item_id: r for r in spark.read.parquet(f"{sf_dir}/intake.parquet").collect()}
    got = {}
    for r in cut_points(spark.read.parquet(f"{sf_dir}/intake.parquet")).collect():
        got.setdefault(r.item_id, []).append(r.cut_tok)
    for i, r in items.items():
        n, w, o = len(r.token_ids or []), r.window_size or 128, 32 if r.overlap_size is None else r.overlap_size
        c = sorted(got.get(i, []))
        assert bool(c) == (n > w)
        begin = 0
        for k, cut in enumerate(c):
            assert begin < cut <= begin + w and (k == 0 or cut > c[k - 1])
            begin = max(0, cut - o)
        assert n - begin <= w or not c


def test_odd_rows(spark):
    text = "aa. bb. cc. dd."
    t, s, e = tokens(text)
    schema = "item_id long, doc_name string, text string, token_ids array<int>, tok_start array<int>, tok_end array<int>, window_size int, overlap_size int, piece string"
    rows = [
        (1, None, text, t, s, e, 3, 0, "x"), (1, None, text, t, s, e, 3, 0, "x"), (2, None, text, None, None, None, 3, 0, "x"), (3, None, text, [], [], [], 3, 0, "x"),
        (4, None, None, t, s, e, 3, 0, "x"), (5, None, text, t, None, None, 3, None, "x"), (6, None, text, t, s, e, None, None, None), (7, None, text, t, [0, None] * 4, e, 5, 1, "x"), (8, None, text, t, s, e, 0, -3, "x"),
    ]
    d = spark.createDataFrame(rows, schema)
    got = {}
    for r in cut_points(d).collect():
        got.setdefault(r.item_id, []).append(r.cut_tok)
    got = {i: sorted(c) for i, c in got.items()}
    assert got == {1: [2, 4, 6], 4: [3, 6], 5: [3, 4, 5, 6, 7], 7: [5], 8: list(range(1, 8))}
    p = {(r.item_id, r.piece): r.piece_text for r in split_items(d).collect()}
    assert [p[1, k] for k in range(4)] == ["aa.", "bb.", "cc.", "dd."] and p[5, 0] is None and p[4, 0] is None
    assert cut_points(d.limit(0)).count() == 0

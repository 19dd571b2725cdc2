"""Problem 6 against the public libraries."""

import os
import random

import pytest

from sparrowlens.llm.encoding import PATTERN, TOKENIZERS, Encoder, encode_word, encoded, load_ranks, token_counts

PATH = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
TEXTS = ["", "Hello world", " a  b\n\n\tc ", "I'll we've DON'T", "naïve café é", "日本語 テキスト 🧭🏽‍🔬", "<|endoftext|> x", "1234567 3.14", "​­﻿", "a" * 3000, "ab " * 2000, "\x00\x01", "ＦＵＬＬ ﬁ", "خريطة ٣٤"]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


def test_same_as_tiktoken_and_tokenizers(reference):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    e = Encoder(load_ranks(PATH))
    for x in TEXTS:
        assert e.ids(x) == reference.encode_ordinary(x) == t.encode(x, add_special_tokens=False).ids, x[:30]


def test_long_and_random_words(reference):
    r, ranks = random.Random(2), load_ranks(PATH)
    for n in (1, 2, 3, 17, 255, 256, 257, 258, 900):
        for alphabet in ("ab", "etaoin ", "éßñ", "aA1_"):
            w = "".join(r.choice(alphabet) for _ in range(n))
            got = encode_word(w.encode(), ranks)
            assert got == reference._core_bpe.encode_single_piece(w.encode())


def test_table(spark, reference, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: reference.encode_ordinary(r.text or "") for r in docs.collect()}
    assert {r.doc_id: r.ids for r in encoded(docs).collect()} == want


def test_nulls_repeats_and_counts(spark):
    d = spark.createDataFrame([(1, "Hello world", 3), (1, "Hello world", 4), (2, None, 3), (3, "", 3), (None, "x", 3), (4, "a", 1), (4, "b", 1)], "doc_id long, text string, ids int")
    got = sorted(((r.doc_id, r.ids) for r in encoded(d).collect()), key=repr)
    assert len(got) == 6 and (1, [15496, 995]) in got and (2, []) in got and (3, []) in got
    assert encoded(d.limit(0)).count() == 0
    n = token_counts(d.select("doc_id", "text"), text="text").collect()
    assert sorted(r.tokens for r in n) == [0, 0, 1, 1, 1, 2, 2]

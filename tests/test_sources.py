"""Packed models, documents, the store, and ingestion."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowlens.operators.model import build_vocabulary, heap_offsets, missing_ids, quantize_rows, token_of
from sparrowlens.plans.staging import shared_dir
from sparrowlens.sources import Store, packed, read_corpus, read_documents
from sparrowlens.streaming import ingest_batch, ingest_stream


def model(spark, tokens, dim=4):
    rng = np.random.default_rng(0)
    d = spark.createDataFrame([(i, t, [float(x) for x in rng.standard_normal(dim)], i / 10) for i, t in enumerate(tokens)], "token_id int, token string, v array<double>, sif double")
    return quantize_rows(d, "token_id", "v").join(d.select("token_id", "token", "sif"), "token_id")


@pytest.mark.parametrize("tokens", [["a"], ["ab", "c"], ["abc", "é", ""], ["[PAD]", "[UNK]", "##x", "日本"]])
def test_packed_round_trip(spark, tmp_path, tokens):
    m, path = model(spark, tokens), str(tmp_path / "m.bin")
    pc = np.arange(8, dtype=np.float32).reshape(2, 4)
    h = packed.write_packed(m, path, pc)
    got, want = packed.read_packed(spark, path).orderBy("token_id").collect(), m.orderBy("token_id").collect()
    assert [r.token for r in got] == tokens and [r.codes for r in got] == [r.codes for r in want]
    assert np.allclose([r.scale for r in got], [r.scale for r in want]) and np.allclose(packed.read_components(path), pc)
    assert h.components_at + pc.nbytes == (tmp_path / "m.bin").stat().st_size


def test_packed_rejects(spark, tmp_path):
    m, path = model(spark, ["a", "b"]), tmp_path / "m.bin"
    packed.write_packed(m, str(path), np.zeros((1, 4)))
    raw = path.read_bytes()
    for bad, what in ((b"XXXX" + raw[4:], "magic"), (raw[:4] + b"\2" + raw[5:], "version"), (raw[:20], "header")):
        path.write_bytes(bad)
        with pytest.raises(ValueError, match=what):
            packed.read_header(str(path))
    with pytest.raises(ValueError, match="length"):
        packed.write_packed(m, str(path), np.zeros((1, 3)))
    with pytest.raises(ValueError, match="ids"):
        packed.write_packed(m.where("token_id = 1"), str(path), np.zeros((1, 4)))


def test_read_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_text("one\ntwo")
    (tmp_path / "sub/b.markdown").write_text("# b")
    (tmp_path / "c.csv").write_text("no")
    assert {r.name: r.text for r in read_documents(spark, str(tmp_path)).collect()} == {"a.TXT": "one\ntwo", "b.markdown": "# b"}
    (tmp_path / "c.json").write_text(json.dumps([{"name": "x", "text": "y"}, {"name": "z", "text": "w"}]))
    assert read_corpus(spark, str(tmp_path / "c.json")).count() == 2


def test_vocabulary_tables(spark):
    counts = spark.createDataFrame([("zeta", 5), ("beta", 5), ("a", 9), ("rare", 1)], "word string, n long")
    v = build_vocabulary(counts, 78)
    assert [r.token for r in v.orderBy("token_id").collect()][-2:] == ["beta", "zeta"] and v.count() == 78
    assert missing_ids(v.where("token_id <> 5"), 78).first().token_id == 5
    ids = spark.createDataFrame([(77,), (500,)], "token_id int")
    assert {r.token_id: r.token for r in token_of(ids, v).collect()} == {77: "zeta", 500: ""}
    o = {r.token_id: r.offset for r in heap_offsets(v).collect()}
    assert o[0] == 0 and o[1] == 5 and o[4] == 20 and o[5] == 21


def tables(spark):
    vocab = spark.createDataFrame([(1, "[UNK]"), (2, "a"), (3, "b")], "token_id int, token string")
    emb = spark.createDataFrame([(2, [1.0, 0.0], 1.0), (3, [0.0, 1.0], 1.0)], "token_id int, vec array<double>, sif double")
    return vocab, emb


def test_store_is_addressed_by_content(spark, tmp_path):
    store, (vocab, emb) = Store(spark, str(tmp_path / "s")), tables(spark)
    docs = spark.createDataFrame([("x.txt", "a b"), ("y.txt", "a b"), ("x.txt", "b"), ("e.txt", ""), ("n.txt", None)], "name string, text string")
    for _ in range(2):
        ingest_batch(store, docs, vocab, emb, 2, np.zeros(2))
    got = {r.doc_name: r.chunk_count for r in store.docs().orderBy("doc_hash").collect()}
    assert got == {"x.txt": 1, "e.txt": 0} and store.docs().count() == 3 and store.chunks().count() == 2
    key = docs.select(F.sha2(F.lit("a b"), 256)).first()[0]
    assert store.get_doc(key).count() == 1
    c = store.get_chunks(key).first()
    assert c.text == "a b" and c.vec == [0.5, 0.5] and (c.char_start, c.char_end) == (0, 3)
    hit, miss = store.lookup(spark.createDataFrame([("b",), ("new",)], "text string"))
    assert hit.first().text == "b" and miss.first().text == "new"
    store.clear()
    assert store.docs().count() == 0 and store.chunks().count() == 0


def test_stream_ingest_once(spark, tmp_path):
    store, (vocab, emb) = Store(spark, str(tmp_path / "s")), tables(spark)
    src = str(tmp_path / "in")
    for text in ("a b", "b a b"):
        spark.createDataFrame([("f", text), ("g", "a")], "name string, text string").write.mode("append").parquet(src)
        stream = spark.readStream.schema("name string, text string").parquet(src)
        ingest_stream(store, stream, vocab, emb, 2, np.zeros(2), checkpoint=str(tmp_path / "c")).awaitTermination()
    assert store.docs().count() == 3 and store.chunks().count() == 3


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_exchange_files(spark, tmp_path):
    from sparrowlens.sources import raw

    m = str(tmp_path / "manifest")
    raw.write_manifest(m, vocab_size=5, hidden_dim=4, model_name="é", model_revision="r1")
    r = raw.read_manifest(spark, m).first()
    assert (r.vocab_size, r.hidden_dim, r.unk_id, r.pad_id, r.model_name, r.model_revision) == (5, 4, 1, 0, "é", "r1") and abs(r.sif_a - 1e-3) < 1e-9
    (tmp_path / "manifest").write_bytes(b"XXXX" + (tmp_path / "manifest").read_bytes()[4:])
    with pytest.raises(ValueError, match="magic"):
        raw.read_manifest(spark, m)
    v = spark.createDataFrame([(0, "a"), (1, "日本"), (2, "")], "token_id int, token string")
    raw.write_vocabulary(v, str(tmp_path / "v"))
    assert raw.read_vocabulary(spark, str(tmp_path / "v")).orderBy("token_id").collect() == v.collect()
    raw.write_vocabulary(v.limit(0), str(tmp_path / "none"))
    assert raw.read_vocabulary(spark, str(tmp_path / "none")).isEmpty()
    (tmp_path / "v").write_bytes((tmp_path / "v").read_bytes()[:-1])
    with pytest.raises(ValueError, match="early"):
        raw.read_vocabulary(spark, str(tmp_path / "v"))
    x = spark.createDataFrame([(1, [3.0, 4.0]), (0, [1.0, 2.0])], "k int, v array<float>")
    assert raw.write_floats(x, str(tmp_path / "f"), "k", "v") == 2
    assert [list(r.vec) for r in raw.read_floats(spark, str(tmp_path / "f"), 2, 2).orderBy("row").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    with pytest.raises(ValueError, match="whole rows"):
        raw.read_floats(spark, str(tmp_path / "f"), 3)
    e = spark.createDataFrame([(0, "t é", [1, 2], [0.5, 0.25]), (1, "", [], [1.0, 2.0])], raw.VALIDATION)
    assert raw.write_validation(e, str(tmp_path / "e"), 2) == 2
    assert raw.read_validation(spark, str(tmp_path / "e"), 2).orderBy("example").collect() == e.collect()
    (tmp_path / "e").write_bytes((tmp_path / "e").read_bytes()[:-1])
    with pytest.raises(ValueError, match="early"):
        raw.read_validation(spark, str(tmp_path / "e"), 2)


def test_sweep(spark):
    from sparrowlens.plans.sweep import sweep

    c = spark.createDataFrame([(1, [2, 3]), (5, [3]), (9, [])], "chunk_ord long, token_ids array<int>")
    seen = []
    r = sweep(c, tables(spark)[1], 2, np.ones(2), sizes=(4, 7), progress=seen.append).collect()
    assert [x.corpus_size for x in r] == [4, 7] and len(seen) == 2 and all(x.speedup > 0 for x in r)

"""The queries of the core over the given tables, and the SQL that states the same results."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import axpy, bytes_label, content_hash, cosine, escape_html, extension, highlight, norm, pretokens, preview, sif_weight
from .functions.vectors import dot
from .operators import check, linear, model
from .operators.kmeans import kmeans
from .operators.order import prefix_sum, resample, with_ordinal
from .operators.pooling import pool, token_matrix
from .operators.search import search, search_one, with_text
from .operators.tokenize import split_words, tokenize, word_counts
from .operators.windows import window_starts, windows
from .plans.indexing import search_tokens, without_axis
from .plans.staging import shared_dir, staged, table
from .sources import packed, raw, read_corpus
from .sources.store import Store
from .sql import ORACLE_SQL, QUERY_TEXT

DIM, K = 64, 8

QUERIES = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


# --- tables the queries share ------------------------------------------------------------


def _emb(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))


def _tokens(spark, d) -> DataFrame:
    """A token table: the given vectors, dealt out over the ids of the vocabulary in turn."""
    e = _emb(spark, d)
    n = e.count()
    v = table(spark, d, "vocab").select("token_id", sif_weight(F.col("token"), F.col("freq"), F.col("token").isin(*model.SPECIAL)).alias("sif"), F.pmod(F.col("token_id").cast("long"), F.lit(n)).alias("vec_id"))
    return v.join(e, "vec_id").select("token_id", "vec", "sif")


def _chunks(spark, d) -> DataFrame:
    """Chunks without repeated rows."""
    return table(spark, d, "chunks").select("chunk_ord", "token_ids").dropDuplicates(["chunk_ord"])


def _pooled(spark, d) -> DataFrame:
    return pool(_chunks(spark, d), _tokens(spark, d), DIM)


def _stored(spark, d) -> DataFrame:
    """Stored vectors of full length and finite numbers, once per chunk."""
    e = table(spark, d, "chunk_emb").select("chunk_ord", "vec").where("size(vec) = 64 and forall(vec, x -> x is not null and not isnan(x))")
    return e.groupBy("chunk_ord").agg(F.min("vec").alias("vec"))


def _items(spark, d) -> DataFrame:
    return table(spark, d, "intake").select("item_id", "doc_name", "text", "token_ids", "tok_start", "tok_end").dropDuplicates(["item_id"])


# --- vectors and search ------------------------------------------------------------------


@_query
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 8 vectors most similar to the first."""
    e = _emb(spark, d)
    first = e.where("vec_id = 0").first()
    return search_one(e, first.vec, K, key="vec_id").select("vec_id", F.round("score", 6).alias("score"))


@_query
def cosine_topk_batch(spark, d):
    """The 8 vectors most similar to every 50th, against all."""
    e = _emb(spark, d)
    hits = search(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e, K, dim=DIM, key="vec_id")
    return hits.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@_query
def chunk_search(spark, d):
    """The 8 chunks most similar to every 50th chunk by stored vectors, with the start of their text."""
    e = _stored(spark, d)
    hits = search(e.where("chunk_ord % 50 = 0").withColumnRenamed("chunk_ord", "query_id"), e, K, dim=DIM)
    texts = table(spark, d, "chunks").select("chunk_ord", preview(F.col("text"), 60).alias("preview")).dropDuplicates(["chunk_ord"])
    return with_text(hits, texts).select("query_id", "rank", "chunk_ord", F.round("score", 6).alias("score"), "preview")


@_query
def embed_search(spark, d):
    """A query text from tokens to the 8 chunks whose pooled vectors are closest."""
    emb = _tokens(spark, d)
    held = token_matrix(emb, DIM)
    held = held and spark.sparkContext.broadcast(held)
    pooled = staged(pool(_chunks(spark, d), emb, DIM, held=held))
    axis = linear.top_component(pooled, DIM)
    q = tokenize(spark.range(0, 1, 1, 1).select(F.col("id").alias("query_id"), F.lit(QUERY_TEXT).alias("text")), table(spark, d, "vocab"))
    qv = without_axis(pool(q, emb, DIM, key="query_id", held=held), axis, "query_id")
    return search(qv, without_axis(pooled, axis, "chunk_ord"), K, dim=DIM).select("chunk_ord", F.round("score", 5).alias("score"))


@_query
def token_search(spark, d):
    """The 8 chunks closest to the tokens of every 50th chunk; a chunk without tokens asks for nothing."""
    chunks = staged(_chunks(spark, d))
    emb = _tokens(spark, d)
    asked = chunks.where("chunk_ord % 50 = 0").withColumnRenamed("chunk_ord", "query_id")
    hits = search_tokens(asked, emb, pool(chunks, emb, DIM), K, dim=DIM)
    return hits.select("query_id", "rank", "chunk_ord", F.round("score", 6).alias("score"))


@_query
def dot_norm(spark, d):
    """Length of every vector and its product with the first."""
    e = _emb(spark, d)
    first = F.array(*[F.lit(x) for x in e.where("vec_id = 0").first().vec])
    return e.select("vec_id", F.round(norm(F.col("vec")), 6).alias("norm"), F.round(dot(F.col("vec"), first), 6).alias("dot0"))


@_query
def similarity_to_mean(spark, d):
    """Similarity of every vector to the mean of all, and what is left without that direction."""
    e = _emb(spark, d)
    n, s, _ = linear.moments(e, DIM)
    mean = F.array(*[F.lit(float(x)) for x in s / n])
    c = cosine(F.col("vec"), mean)
    rest = axpy(F.col("vec"), -dot(F.col("vec"), mean), mean)
    return e.select("vec_id", F.round(c, 6).alias("cos_mean"), F.round(norm(rest), 6).alias("rest_norm"))


@_query
def topk_overlap(spark, d):
    """How far search over 8-bit vectors agrees with search over the originals."""
    e = _emb(spark, d)
    q = e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    codes = model.quantize_rows(e, "vec_id", "vec")
    back = codes.select("vec_id", F.transform("codes", lambda x: x.cast("double") * F.col("scale")).alias("vec"))
    full, coded = search(q, e, K, dim=DIM, key="vec_id"), search(q, back, K, dim=DIM, key="vec_id")
    return check.compare_hits(full, coded, "vec_id").select("query_id", F.round("overlap", 6).alias("overlap"), F.round("max_delta", 5).alias("max_delta"))


# --- the model ---------------------------------------------------------------------------


@_query
def quantize_rows(spark, d):
    """8-bit codes and step of every vector."""
    q = model.quantize_rows(_emb(spark, d), "vec_id", "vec")
    return q.select("vec_id", F.round("scale", 9).alias("scale"), F.transform("codes", lambda x: x.cast("int")).alias("codes"))


@_query
def quantize_error(spark, d):
    """Largest error and cosine of every coded vector."""
    q = model.quantize_error(_emb(spark, d), "vec_id", "vec")
    return q.select("vec_id", F.round("max_error", 8).alias("max_error"), F.round("cosine", 8).alias("cosine"))


@_query
def quantize_report(spark, d):
    """Fidelity of the coded chunk vectors."""
    r = model.fidelity(model.quantize_error(_stored(spark, d), "chunk_ord", "vec"))
    return r.select("rows", *[F.round(c, 8).alias(c) for c in ("min_cosine", "mean_cosine", "max_cosine", "max_error")])


@_query
def compression_ratio(spark, d):
    """Bytes of the chunk vectors as floats and as codes."""
    return model.compression(_stored(spark, d), "vec")


@_query
def sif_weights(spark, d):
    """Weight of every token of the vocabulary."""
    return model.weighted(table(spark, d, "vocab")).select("token_id", "token", F.round("sif", 6).alias("sif"))


@_query
def vocab_build(spark, d):
    """A vocabulary of 2,000 pieces from the words of the documents."""
    return model.build_vocabulary(word_counts(table(spark, d, "documents").dropDuplicates(["doc_id"])), 2000)


@_query
def vocab_offsets(spark, d):
    """Place of every token in the packed string heap."""
    return model.heap_offsets(table(spark, d, "vocab"))


@_query
def vocab_preview(spark, d):
    """The first 200 tokens of the vocabulary."""
    return table(spark, d, "vocab").select("token_id", "token").orderBy("token_id").limit(200)


@_query
def report_lines(spark, d):
    """A line of the fidelity report for every coded chunk vector."""
    return raw.report_lines(model.quantize_error(_stored(spark, d), "chunk_ord", "vec"), "chunk_ord")


@_query
def vocab_lookup(spark, d):
    """Number of uses of each token id in the chunks, with its token."""
    used = _chunks(spark, d).select(F.explode("token_ids").alias("token_id")).where("token_id is not null").groupBy("token_id").agg(F.count(F.lit(1)).alias("n"))
    return model.token_of(used, table(spark, d, "vocab")).select("token_id", "token", "n")


# --- text --------------------------------------------------------------------------------


@_query
def pretokenize_counts(spark, d):
    """Words and marks of every document, and how many are distinct."""
    docs = table(spark, d, "documents").dropDuplicates(["doc_id"]).where("text is not null").select("doc_id", pretokens(F.col("text")).alias("w"))
    return docs.select("doc_id", F.size("w").alias("words"), F.size(F.array_distinct("w")).alias("distinct_words"))


@_query
def word_freq(spark, d):
    """How often each word or mark occurs in the documents."""
    return word_counts(table(spark, d, "documents").dropDuplicates(["doc_id"]))


@_query
def wordpiece_pieces(spark, d):
    """Pieces of every distinct word of the documents."""
    words = word_counts(table(spark, d, "documents").dropDuplicates(["doc_id"])).select("word")
    return split_words(words, table(spark, d, "vocab"))


@_query
def tokenize_documents(spark, d):
    """Tokens and spans of every document, over its normalized text."""
    t = tokenize(table(spark, d, "documents").select("doc_id", "text").dropDuplicates(["doc_id"]), table(spark, d, "vocab"))
    return t.select("doc_id", "token_ids", "tok_start", "tok_end")


@_query
def token_spans(spark, d):
    """Tokens and spans of every document that has a text, over the text as it stands."""
    t = tokenize(table(spark, d, "documents").where("text is not null").select("doc_id", "text").dropDuplicates(["doc_id"]), table(spark, d, "vocab"), normalize=False)
    return t.select("doc_id", "token_ids", "tok_start", "tok_end")


@_query
def html_escaped(spark, d):
    """Every document safe for HTML."""
    return table(spark, d, "documents").dropDuplicates(["doc_id"]).select("doc_id", escape_html(F.col("text")).alias("html"))


@_query
def highlighted(spark, d):
    """Every document with the terms of a query marked."""
    return table(spark, d, "documents").dropDuplicates(["doc_id"]).select("doc_id", highlight(F.col("text"), QUERY_TEXT).alias("html"))


@_query
def preview_truncate(spark, d):
    """The first 220 characters of every chunk."""
    return table(spark, d, "chunks").select("chunk_ord", "text").distinct().select("chunk_ord", preview(F.col("text")).alias("preview"))


@_query
def format_bytes(spark, d):
    """Size of every document as a label."""
    n = F.octet_length("text").cast("double") * 97
    return table(spark, d, "documents").dropDuplicates(["doc_id"]).where("text is not null").select("doc_id", bytes_label(n).alias("size"))


@_query
def file_types(spark, d):
    """Documents by the extension of their name, and whether it can be read."""
    docs = table(spark, d, "documents").dropDuplicates(["doc_id"]).where("doc_name is not null")
    e = extension(F.col("doc_name"))
    return docs.groupBy(e.alias("extension")).agg(F.count(F.lit(1)).alias("n")).withColumn("readable", F.col("extension").isin("txt", "md", "markdown", "pdf"))


# --- windows -----------------------------------------------------------------------------


@_query
def window_counts(spark, d):
    """Windows of every item under the default options."""
    return _items(spark, d).select("item_id", F.coalesce(F.size("token_ids"), F.lit(0)).alias("n")).select("item_id", F.size(window_starts(F.col("n"))).alias("windows"))


@_query
def token_windows(spark, d):
    """Every window of every item: tokens, characters, text and id."""
    w = windows(_items(spark, d))
    return w.select("item_id", "start", "n_tok", "token_ids", "char_start", "char_end", "chunk_text", "chunk_id")


@_query
def csr_offsets(spark, d):
    """Place of every chunk in the flat list of all token ids."""
    n = _chunks(spark, d).select("chunk_ord", F.coalesce(F.when(F.col("token_ids").isNotNull(), F.size("token_ids")), F.lit(0)).alias("n"))
    return prefix_sum(n, ["chunk_ord"], "n", "offset").select("chunk_ord", "offset", "n")


@_query
def resampled(spark, d):
    """Token counts of the vectors' rows repeated to three and a half times their number."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    n = e.count()
    return resample(with_ordinal(e, ["vec_id"]), "ord", n, n * 7 // 2).select("sample_id", "vec_id", "label")


# --- pooling and layout --------------------------------------------------------------------


@_query
def sif_pool(spark, d):
    """Pooled vector of every chunk."""
    return _pooled(spark, d).select("chunk_ord", F.transform("vec", lambda x: F.round(x, 5) + 0.0).alias("vec"))


@_query
def pc_remove(spark, d):
    """Length of every pooled vector without the common component."""
    p = staged(_pooled(spark, d))
    v = without_axis(p, linear.top_component(p, DIM), "chunk_ord")
    return v.select("chunk_ord", F.round("norm", 4).alias("norm"))


def _pooled_both(spark, d) -> tuple[DataFrame, DataFrame]:
    """Chunks pooled from the token vectors and from their 8-bit codes, both without the common component."""
    chunks, tokens = staged(_chunks(spark, d)), staged(_tokens(spark, d))
    full = staged(pool(chunks, tokens, DIM))
    axis = linear.top_component(full, DIM)
    return without_axis(full, axis, "chunk_ord"), without_axis(pool(chunks, model.coded_tokens(tokens, DIM), DIM), axis, "chunk_ord")


@_query
def quantized_pool(spark, d):
    """Cosine of every chunk pooled from coded tokens to the same chunk pooled from the token vectors."""
    return check.cosines(*_pooled_both(spark, d), "chunk_ord", degenerate=0.0).select("chunk_ord", F.round("cosine", 6).alias("cosine"))


@_query
def quantized_pool_report(spark, d):
    """Fidelity of the coded model over all chunks."""
    r = check.compare_vectors(*_pooled_both(spark, d), "chunk_ord")
    return r.select("rows", *[F.round(c, 6).alias(c) for c in ("min_cosine", "mean_cosine", "max_cosine")])


@_query
def report_head(spark, d):
    """The head of the fidelity report of the coded chunk vectors."""
    v = _stored(spark, d)
    return raw.report_head(model.compression(v, "vec"), model.quantize_error(v, "chunk_ord", "vec"))


@_query
def column_means(spark, d):
    """Mean of every coordinate of the chunk vectors."""
    return linear.column_means(_stored(spark, d), DIM).select("i", F.round("mean", 6).alias("mean"))


@_query
def gram_matrix(spark, d):
    """Sums of products of the coordinates of the chunk vectors."""
    g = linear.gram(_stored(spark, d), DIM)
    return spark.createDataFrame([(a, b, float(g[a, b])) for a in range(DIM) for b in range(DIM)], "a int, b int, g double").select("a", "b", F.round("g", 9).alias("g"))


@_query
def project2d(spark, d):
    """Chunk vectors along the two leading axes."""
    p = linear.layout(_stored(spark, d), DIM, "chunk_ord")
    return p.select("chunk_ord", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def _drawn(spark, d) -> DataFrame:
    """The latest drawing of every chunk that has coordinates; ties to the smallest place."""
    p = table(spark, d, "map_points").where("x is not null and y is not null")
    last = p.groupBy("chunk_ord").agg(F.min(F.struct((-F.unix_micros("drawn_at")).alias("t"), "x", "y", F.coalesce("cluster_no", F.lit(-1)).alias("c"))).alias("p"))
    return last.select("chunk_ord", "p.x", "p.y", F.col("p.c").alias("cluster_no"))


@_query
def map_normalize(spark, d):
    """The map's points scaled to its frame, with the colour of their cluster."""
    p = linear.normalized_map(_drawn(spark, d))
    return p.select("chunk_ord", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.pmod("cluster_no", F.lit(8)).alias("colour"))


@_query
def nearest_pick(spark, d):
    """The point of the map next to a click."""
    return linear.pick(linear.normalized_map(_drawn(spark, d)), 0.1, 0.05, "chunk_ord").select("chunk_ord", F.round("dist2", 8).alias("dist2"))


@_query
def map_clusters(spark, d):
    """The chunks' places along the two leading axes with their cluster and its colour."""
    v = staged(_stored(spark, d))
    p = linear.layout(v, DIM, "chunk_ord").join(kmeans(v, DIM, 7, key="chunk_ord"), "chunk_ord")
    return p.select("chunk_ord", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "cluster", F.pmod("cluster", F.lit(8)).alias("colour"))


@_query
def kmeans_assign(spark, d):
    """Cluster of every vector after 15 rounds with 7 centres."""
    return kmeans(_emb(spark, d), DIM, 7, key="vec_id")


@_query
def kmeans_sizes(spark, d):
    """Size of every cluster."""
    return kmeans(_emb(spark, d), DIM, 7, key="vec_id").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


# --- the corpus and its store ------------------------------------------------------------


@_query
def doc_hash(spark, d):
    """Content hash of every document."""
    return table(spark, d, "documents").dropDuplicates(["doc_id"]).select("doc_id", content_hash(F.col("text")).alias("doc_hash"))


@_query
def cache_hits(spark, d):
    """Files of the chunks that the store knows by exact hash, with their number of chunks."""
    known = table(spark, d, "cached_docs").select("doc_hash").where("doc_hash is not null")
    return _files(spark, d).join(known, "doc_hash", "left_semi")


@_query
def cache_misses(spark, d):
    """Files of the chunks that the store does not know."""
    known = table(spark, d, "cached_docs").select("doc_hash").where("doc_hash is not null")
    return _files(spark, d).join(known, "doc_hash", "left_anti")


def _files(spark, d) -> DataFrame:
    return table(spark, d, "chunks").where("doc_hash is not null").groupBy("doc_hash").agg(F.countDistinct("chunk_ord").alias("chunks"))


@_query
def cached_counts(spark, d):
    """Files whose stored number of chunks differs from the chunks there are."""
    meta = table(spark, d, "cached_docs").groupBy("doc_hash").agg(F.max("chunk_count").alias("stored"))
    return _files(spark, d).join(meta, "doc_hash").where("stored is null or stored <> chunks").select("doc_hash", "chunks", F.coalesce("stored", F.lit(-1)).alias("stored"))


@_query
def union_corpus(spark, d):
    """Texts of both collections together, by the collection and whether they are empty."""
    a = table(spark, d, "documents").select(F.lit("documents").alias("origin"), "text")
    b = table(spark, d, "intake").select(F.lit("intake").alias("origin"), "text")
    return a.unionByName(b).groupBy("origin", F.coalesce(F.trim("text") == "", F.lit(True)).alias("blank")).agg(F.count(F.lit(1)).alias("n"))


@_query
def distinct_docs(spark, d):
    """Names of the documents and how many there are of each."""
    docs = table(spark, d, "documents").where("doc_name is not null")
    return docs.groupBy("doc_name").agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("text").alias("texts"))


@_query
def latest_meta(spark, d):
    """The entry of every file that was synchronized last."""
    w = Window.partitionBy("doc_hash").orderBy(F.desc_nulls_last("synced_at"), "meta_id")
    rows = table(spark, d, "cached_docs").where("doc_hash is not null").distinct()
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("doc_hash", "meta_id", "doc_name")


@_query
def missing_ids(spark, d):
    """Ids below 40,000 that the vocabulary lacks."""
    return model.missing_ids(table(spark, d, "vocab"), 40_000)


# --- files and streams ---------------------------------------------------------------------


def _new_path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{os.urandom(8).hex()}"


def _axis(spark, d) -> np.ndarray:
    return linear.top_component(_pooled(spark, d), DIM)


@_query
def codec_roundtrip(spark, d):
    """The quantized token table written to one packed file and read back."""
    tokens = _tokens(spark, d).join(table(spark, d, "vocab").select("token_id", "token"), "token_id")
    q = model.quantize_rows(tokens, "token_id", "vec").join(tokens.select("token_id", "token", "sif"), "token_id")
    path = raw.local(_new_path(spark, "model"))
    packed.write_packed(q, path, _axis(spark, d)[None, :])
    back = packed.read_packed(spark, path)
    return back.select("token_id", "token", F.transform("codes", lambda x: x.cast("int")).alias("codes"), F.round("scale", 6).alias("scale"), F.round("sif", 6).alias("sif"))


@_query
def packed_sections(spark, d):
    """Where the sections of the packed model of the vocabulary start, and its size in bytes."""
    v = table(spark, d, "vocab").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0)).alias("heap")).first()
    h = packed.Header(v.n, DIM, 1, 1, 2, 3, 0, 1e-3, blob=v.heap)
    places = [("offsets", h.offsets_at), ("heap", h.blob_at), ("codes", h.codes_at), ("scales", h.scales_at), ("weights", h.sif_at), ("components", h.components_at), ("end", h.components_at + 4 * DIM)]
    return spark.createDataFrame(places, "section string, starts long")


@_query
def vocab_file_roundtrip(spark, d):
    """The vocabulary written to one file and read back."""
    path = raw.local(_new_path(spark, "vocab"))
    raw.write_vocabulary(table(spark, d, "vocab").select("token_id", F.coalesce("token", F.lit("")).alias("token")), path)
    return raw.read_vocabulary(spark, path)


@_query
def raw_roundtrip(spark, d):
    """The given vectors written as rows of floats and read back in ranges."""
    path = raw.local(_new_path(spark, "floats"))
    n = raw.write_floats(_emb(spark, d), path, "vec_id", "vec")
    return raw.read_floats(spark, path, DIM, n).select(F.col("row").alias("vec_id"), F.transform("vec", lambda x: F.round(x.cast("double"), 6) + 0.0).alias("vec"))


@_query
def corpus_roundtrip(spark, d):
    """The documents written as JSON and read back as a corpus; how many there are of each name."""
    path = _new_path(spark, "corpus")
    table(spark, d, "documents").select(F.col("doc_name").alias("name"), "text").write.json(path)
    return read_corpus(spark, path, lines=True).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("chars"))


@_query
def store_roundtrip(spark, d):
    """Every document indexed into a fresh store twice over; what the store then holds."""
    from .streaming.ingest import ingest_batch

    store = Store(spark, _new_path(spark, "store"))
    emb, vocab, axis = staged(_tokens(spark, d)), table(spark, d, "vocab"), _axis(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_name").alias("name"), "text")
    for _ in range(2):
        ingest_batch(store, docs, vocab, emb, DIM, axis)
    return store.docs().select("doc_hash", "doc_name", (F.col("chunk_count") > 0).alias("has_windows"))


def _item_store(spark, d) -> Store:
    """A store of the windows of the items, each under the hash of its text."""
    store = Store(spark, _new_path(spark, "store"))
    items = _items(spark, d).where("text is not null").withColumn("doc_hash", F.sha2("text", 256))
    w = windows(items).select("doc_hash", "start", "doc_name", F.col("chunk_text").alias("text"), "token_ids", "char_start", "char_end")
    v = pool(w.withColumn("_id", F.concat_ws("#", "doc_hash", "start")), _tokens(spark, d), DIM, key="_id", keep=True)
    meta = items.groupBy("doc_hash").agg(F.min("doc_name").alias("doc_name")).select("doc_hash", "doc_name", F.lit(0).alias("chunk_count"), F.current_timestamp().alias("added_at"))
    store.put(meta, v.withColumn("norm", norm(F.col("vec"))))
    return store


@_query
def store_chunks(spark, d):
    """The windows of the items: how many there are of each text, and the last character."""
    store = _item_store(spark, d)
    return store.chunks().groupBy("doc_hash").agg(F.count(F.lit(1)).alias("windows"), F.max("char_end").alias("last_char"))


@_query
def store_lookup(spark, d):
    """The windows that the store of the items gives for the text of its first item with tokens, in order."""
    store = _item_store(spark, d)
    first = _items(spark, d).where("text is not null and size(token_ids) > 0").orderBy("item_id").select(F.sha2("text", 256).alias("h")).first()
    of = store.get_doc(first.h).select("doc_hash", F.col("doc_name").alias("known_as"))
    return store.get_chunks(first.h).join(of, "doc_hash").select("start", "char_start", "char_end", F.size("token_ids").alias("n_tok"), "known_as")


@_query
def store_cleared(spark, d):
    """Entries of a store of the items before and after it is emptied."""
    store = _item_store(spark, d)
    count = lambda when: store.docs().agg(F.lit(when).alias("at"), F.count(F.lit(1)).alias("docs"))
    before = staged(count("before"))
    store.clear()
    return before.unionByName(count("after"))


@_query
def stream_ingest(spark, d):
    """The documents as a stream of files into a fresh store; the texts that have windows."""
    from .streaming.ingest import ingest_stream

    base = _new_path(spark, "stream")
    store = Store(spark, f"{base}/store")
    emb, vocab = staged(_tokens(spark, d)), table(spark, d, "vocab")
    docs = table(spark, d, "documents").select(F.col("doc_name").alias("name"), "text")
    docs.write.parquet(f"{base}/in")
    arriving = spark.readStream.schema(docs.schema).parquet(f"{base}/in")
    ingest_stream(store, arriving, vocab, emb, DIM, _axis(spark, d), checkpoint=f"{base}/checkpoint").awaitTermination()
    return store.chunks().groupBy("doc_hash").agg(F.min("start").alias("first_start"), F.min("doc_name").alias("doc_name"))

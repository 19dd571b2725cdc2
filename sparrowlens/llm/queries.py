"""The queries of the eight problems, and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import staged, table
from .clusters import describe_clusters, pairs_within, similarity_clusters
from .copies import collapsed, copies, hashed_records, hashed_texts
from .encoding import encoded
from .frequencies import marked, term_frequencies
from .mixture import mixture, shares
from .neighbours import nearest_neighbours, neighbour_pairs
from .pieces import cut_points, split_items
from .privacy import calibrated, items_of, redacted_of, scored, trained


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of probes in one cluster."""
    return pairs_within(similarity_clusters(table(spark, sf_dir, "chunk_emb")), table(spark, sf_dir, "map_probes").select("chunk_ord"))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster with its size and most typical chunks."""
    return describe_clusters(similarity_clusters(table(spark, sf_dir, "chunk_emb")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cut of each oversized item."""
    return cut_points(table(spark, sf_dir, "intake"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each oversized item with their texts."""
    return split_items(table(spark, sf_dir, "intake"))


def _p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks")
    records = chunks.select("chunk_ord").distinct().count()
    return marked(term_frequencies(chunks), records)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids that are too rare or too common."""
    return _p3(spark, sf_dir).where("term > 3 and mark is not null").select(F.col("term").alias("token_id"), "mark")


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and chunks of every token id."""
    return _p3(spark, sf_dir).select(F.col("term").alias("token_id"), "occurrences", F.col("records").alias("chunks"), "mark")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each probe with each of its 8 nearest chunks."""
    near = nearest_neighbours(table(spark, sf_dir, "chunk_emb"), table(spark, sf_dir, "near_probes").select("chunk_ord"))
    return neighbour_pairs(near)


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8 nearest chunks of every chunk whose number is divisible by 50, against all."""
    emb = table(spark, sf_dir, "chunk_emb")
    near = nearest_neighbours(emb, emb.select("chunk_ord").where("chunk_ord % 50 = 0"))
    return near.select(F.col("ord").alias("chunk_ord"), "rank", F.col("other").alias("neighbour"), F.round("cos", 6).alias("cos"))


def _p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = hashed_texts(table(spark, sf_dir, "chunks"), "chunk_ord", "text").withColumn("tab", F.lit("chunks"))
    rows = hashed_records(table(spark, sf_dir, "cached_docs"), "meta_id", ["doc_hash", "doc_name"]).withColumn("tab", F.lit("cached_docs"))
    return copies(texts.unionByName(rows), ("tab",))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each copy with the first record of its group."""
    return _p5(spark, sf_dir).select("tab", "first_id", "copy_id")


def p5_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each group of copies, with the number of its members."""
    return collapsed(_p5(spark, sf_dir), ("tab",))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte_bpe_50k ids of each document."""
    return encoded(table(spark, sf_dir, "documents"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the mixture and how often each is used."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each source reached in the mixture, next to its target."""
    return shares(p7_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def _p8(spark: SparkSession, sf_dir: str, *, text: bool):
    """Every span of every document with its score, and the model calibrated on them."""
    documents = table(spark, sf_dir, "documents")
    model = trained(documents, table(spark, sf_dir, "vocab"), table(spark, sf_dir, "given_names"))
    rows = staged(scored(documents, model, keep_text=text))
    return rows, calibrated(model, rows)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item of personal information."""
    return items_of(*_p8(spark, sf_dir, text=False)).select("doc_id", "kind", "char_start")


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders."""
    return redacted_of(*_p8(spark, sf_dir, text=True))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_clusters, p2_found, p2_pieces, p3_found, p3_terms, p4_found, p4_neighbours, p5_found, p5_collapsed, p6_ids, p7_mixture, p7_shares, p8_found, p8_redacted)
}

_COUNTED = """
with chunk as (select distinct chunk_ord, token_ids from chunks),
     term as (select chunk_ord, unnest(token_ids) as token_id from chunk),
     counted as (select token_id, count(*) as occurrences, count(distinct chunk_ord) as chunks from term where token_id is not null group by token_id),
     marked as (select token_id, occurrences, chunks,
                       case when chunks < 3 then 'rare'
                            when chunks > 0.4 * (select count(distinct chunk_ord) from chunk) then 'common' end as mark
                from counted)
"""

ORACLE_SQL = {
    "p3_found": _COUNTED + "select token_id, mark from marked where token_id > 3 and mark is not null",
    "p3_terms": _COUNTED + "select token_id, occurrences, chunks, mark from marked",
}

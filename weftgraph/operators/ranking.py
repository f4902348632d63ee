"""Ranking of concepts by frequency, degree and TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_count, chunks, idf, priority_bonus
from .positions import counted

RANKED_LABELS = ("Concept", "Keyword", "Method", "Dataset")


def term_weights(terms: DataFrame, documents: DataFrame, size: int = 6000, overlap: int = 800) -> DataFrame:
    """``doc_id, name, tf, df, n``: occurrences of each term in its document, chunks that contain it, and all chunks.

    The terms of a document come to its text as one array and are looked up in an index of the text, which is copied neither for its terms nor, if it is ASCII, for its chunks. A null text is one
    chunk that contains nothing, and its ``tf`` is null.
    """
    grouped = terms.groupBy("doc_id").agg(F.collect_set("name").alias("names"))
    plain = F.coalesce(F.length("text") == F.octet_length("text"), F.lit(True))
    pieces = F.when(~plain, F.transform(chunks(F.col("text"), size, overlap), lambda c: F.lower(c["chunk"])))
    lowered = F.transform("names", lambda name: F.struct(name.alias("name"), F.lower(name).alias("low")))
    n = chunk_count(F.length("text"), size, overlap).cast("long")
    # texts meet their terms by a shuffle also where these would fit a broadcast: a small file is read by one task, which would then do all the counting
    rows = documents.join(grouped.hint("merge"), "doc_id").select("doc_id", n.alias("n"), F.lower("text").alias("low"), pieces.alias("pieces"), lowered.alias("names"))
    return counted(rows, size, overlap)


def tfidf(terms: DataFrame, documents: DataFrame, size: int = 6000, overlap: int = 800) -> DataFrame:
    return term_weights(terms, documents, size, overlap).withColumn("tfidf", F.col("tf") * idf(F.col("n"), F.col("df")))


def top_concepts(scored: DataFrame, keep: int = 80) -> DataFrame:
    """``scored(doc_id, name, label, tfidf, degree, freq, ord)``: ranked labels keep their best ``keep`` by score, others all stay."""
    score = (F.col("tfidf") + F.col("degree") * 5 + F.col("freq") * 10) * priority_bonus(F.col("name"))
    ranked = F.col("label").isin(*RANKED_LABELS)
    rank = F.row_number().over(Window.partitionBy("doc_id", "ranked").orderBy(F.desc("score"), "ord"))
    rows = scored.withColumn("score", score).withColumn("ranked", ranked).withColumn("rank", rank)
    return rows.where(~F.col("ranked") | (F.col("rank") <= keep)).drop("ranked")

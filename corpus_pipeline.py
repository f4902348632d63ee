"""From raw documents to packed training sequences.

Five stages, each one operator of ``weftgraph.llm`` over all that its predecessor kept. Between stages the documents are written as
Parquet to the shared folder and read again, so a lost executor never costs more than the stage at hand.

Null or empty texts fall at the quality rules; of near copies (five-word shingles, Jaccard 0.8) the smallest ``doc_id`` stays; strings of
200 bytes that occur again are cut out of ``text``; documents that hold a benchmark item go; what is left is packed into sequences of
at most 4096 ids. An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import decontaminate, ngram_join, packing, quality, suffix_dedup
from weftgraph.llm.runtime import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, k=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(docs, length=200)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, window=4096, end_id=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: The robust estimate and the token ids have no SQL form; ``tests/llm`` holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

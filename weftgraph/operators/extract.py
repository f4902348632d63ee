"""Deterministic extraction of named concepts and relations from chunks.

Chunks are rows ``doc_id, chunk_no, chunk``. Order decides much here (the first mention names a concept, at most ``per_chunk`` stay), so
every mention carries ``sent`` and ``ord``. Everything is a column expression or a join within a chunk.
"""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import STOP_WORDS, generic_words, singularize
from ..functions.text import ellipsis, sentences

# Nouns that end a technical phrase.
DOMAIN_NOUNS = (
    "system", "architecture", "method", "algorithm", "model", "approach", "framework", "network", "function", "mechanism", "protocol",
    "identity", "ledger", "credit", "market", "infrastructure", "verification", "technology", "proof", "signature", "decryption",
    "blockchain", "contract", "security",
)
# Patterns of names that tell their label, of the verbs that define, of the words between two names that tell their relation, signs at the edges of words.
_INSTITUTION = "University|Institute|Research|Lab|Company|Google|Microsoft"
_DATASET = "dataset|benchmark|corpus|data|source|wmt|imagenet|glue"
_METHOD = "method|algorithm|model|approach|architecture|framework|network|function|optimizer"
_SECTION = "^(Chapter|Section)"
_DEFINES = "is\\s+defined\\s+as|refers\\s+to|represents|denotes|means|is\\s+an?|is|are|were|was"
_REQUIRES = "depends|requires|built upon"
_PRECEDES = "precedes|comes before"
_EXTENDS = "extends|generalizes|is a type of"
_CONTRADICTS = "contradicts|opposes|in contrast to"
_USES = "uses|utilizes|employs"
_EVALUATED = "evaluated|tested|benchmark"
_EDGE = "^[,.;:()\\[\\]{}!?\"']+|[,.;:()\\[\\]{}!?\"']+$"


def sentence_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "chunk_no", F.posexplode(sentences(F.col("chunk"))).alias("sent", "sentence"))


def phrase_label(name: Column, trimmed: bool = True) -> Column:
    """``trimmed``: a name that ends in a space once its ending is cut (``Class S``) is one word without it; else the space makes it a phrase."""
    low = F.lower(name)
    word = F.size(F.split(F.trim(name), "\\s+")) == 1 if trimmed else ~name.rlike("\\s")
    return (
        F.when(name.rlike(_INSTITUTION), "Institution")
        .when(low.rlike(_DATASET), "Dataset")
        .when(low.rlike(_METHOD), "Method")
        .when(name.rlike(_SECTION), "Topic")
        .when(word & (F.length(name) > 3), "Keyword")
        .otherwise("Concept")
    )


def _defines(sentence: Column) -> Column:
    return sentence.rlike(f"(?i)\\s(?:{_DEFINES})\\s")


def definition(phrase: Column, sentence: Column) -> Column:
    """What a sentence says a phrase is, else the sentence cut to 150 characters."""
    pattern = F.concat(F.lit("(?i)\\b\\Q"), phrase, F.lit(f"\\E\\b\\s+(?:{_DEFINES})\\s+([^.!?\\n]{{5,150}})"))
    # a pattern of each row is compiled for each: only where the fixed part of it is found
    said = F.when(_defines(sentence), F.trim(F.call_function("regexp_extract", sentence, pattern, F.lit(1))))
    return F.when(said != "", F.concat(F.upper(F.substring(said, 1, 1)), F.substring(said, F.lit(2), F.length(said)))).otherwise(ellipsis(sentence, 150))


def capitalised_phrases(sents: DataFrame) -> DataFrame:
    """``doc_id, chunk_no, sent, ord, phrase, name``: runs of capitalised words in order of appearance."""
    runs = F.regexp_extract_all("sentence", F.lit("\\b([A-Z][a-zA-Z0-9'-]*(?:\\s+[A-Z][a-zA-Z0-9'-]*)*)\\b"), F.lit(1))
    rows = sents.select("*", F.posexplode(runs).alias("ord", "phrase"))
    rows = rows.where(~F.lower("phrase").isin(*STOP_WORDS) & (F.length("phrase") >= 3))
    return rows.withColumn("name", singularize(F.col("phrase")))


def suffix_phrases(sents: DataFrame, generic: Iterable[str] | None = None) -> DataFrame:
    """Technical phrases: a domain noun with one or two plain words before it, each word capitalised."""
    generic = generic_words(generic or ())
    # words are taken apart only where one of the nouns stands in the sentence
    sents = sents.where(F.lower("sentence").rlike("|".join(DOMAIN_NOUNS)))
    bare = F.transform(F.split("sentence", "\\s+"), lambda w: F.regexp_replace(w, _EDGE, ""))
    rows = sents.withColumn("w", bare).select("*", F.posexplode("w").alias("ord", "noun")).where(F.lower("noun").isin(*DOMAIN_NOUNS))
    plain = lambda w: w.isNotNull() & w.rlike("(?U)^\\p{L}+$") & (F.upper(w) != w) & ~F.lower(w).isin(*generic)
    one, two = F.when(F.col("ord") >= 1, F.get("w", F.col("ord") - 1)), F.when(F.col("ord") >= 2, F.get("w", F.col("ord") - 2))
    phrase = F.when(plain(one) & plain(two), F.concat_ws(" ", two, one, "noun")).when(plain(one), F.concat_ws(" ", one, "noun"))
    name = F.array_join(F.transform(F.split(singularize(phrase), "\\s+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), " ")
    rows = rows.withColumn("phrase", phrase).where("phrase is not null").withColumn("name", name)
    return rows.where(F.length("name") > 3).drop("w", "noun")


def suffix_label(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike(_METHOD), "Method").when(low.rlike(_DATASET), "Dataset").when(low.rlike("blockchain|oracle|satellite|system|technology"), "Technology").otherwise("Concept")


def concepts(chunks: DataFrame, per_chunk: int = 15, generic: Iterable[str] | None = None) -> DataFrame:
    """``doc_id, chunk_no, ord, label, name, description``: the first ``per_chunk`` distinct names of each chunk."""
    sents = sentence_rows(chunks)
    # of a sentence in which nothing is defined only what a description shows goes on; names are labelled and described once those that stay are known
    shown = F.substring("sentence", 1, 151)
    sents = sents.withColumn("told", F.when(_defines(F.col("sentence")), F.col("sentence")).otherwise(shown))
    a = capitalised_phrases(sents).select("doc_id", "chunk_no", F.lit(0).alias("pass"), "sent", "ord", "phrase", "name", "told")
    b = suffix_phrases(sents, generic).select("doc_id", "chunk_no", F.lit(1).alias("pass"), "sent", "ord", "phrase", "name", shown.alias("told"))
    place = F.struct("pass", "sent", "ord")
    first = a.unionByName(b).groupBy("doc_id", "chunk_no", F.lower("name").alias("key")).agg(F.min_by(F.struct("phrase", "name", "told"), place).alias("c"), F.min(place).alias("place"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "chunk_no").orderBy("place"))
    kept = first.withColumn("ord", rank - 1).where(F.col("ord") < per_chunk).select("doc_id", "chunk_no", "ord", F.col("place.pass").alias("pass"), "c.*")
    label = F.when(F.col("pass") == 0, phrase_label(F.col("name"))).otherwise(suffix_label(F.col("name")))
    about = F.when(F.col("pass") == 0, definition(F.col("phrase"), F.col("told"))).otherwise(ellipsis(F.col("told"), 150))
    return kept.select("doc_id", "chunk_no", "ord", label.alias("label"), "name", about.alias("description"))


def relations(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, chunk_no, sent, from_name, to_name, type``: pairs of concepts in one sentence, by the words between them."""
    # the pattern folds A-Z only; one is compiled for each row, so names that do not stand in the sentence at all go first
    folded = lambda c: F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    sents = sentence_rows(chunks).withColumn("folded", folded("sentence"))
    there = F.contains("folded", F.col("key"))
    here = F.regexp_like("sentence", F.concat(F.lit("(?i)\\b\\Q"), F.col("name"), F.lit("\\E\\b")))
    names = found.select("doc_id", "chunk_no", "ord", "label", "name", folded("name").alias("key"))
    seen = sents.join(names, ["doc_id", "chunk_no"]).where(F.when(there, here).otherwise(F.lit(False)))
    a = seen.select("doc_id", "chunk_no", "sent", "sentence", F.col("ord").alias("i"), F.col("name").alias("c1"), F.col("label").alias("l1"))
    b = seen.select("doc_id", "chunk_no", "sent", F.col("ord").alias("j"), F.col("name").alias("c2"), F.col("label").alias("l2"))
    pair = a.join(b, ["doc_id", "chunk_no", "sent"]).where("i < j")
    low = F.lower("sentence")
    p1, p2 = F.call_function("locate", F.lower("c1"), low), F.call_function("locate", F.lower("c2"), low)
    pair = pair.withColumn("p1", p1).withColumn("p2", p2)
    start = F.least("p1", "p2") + F.when(F.col("p1") < F.col("p2"), F.length("c1")).otherwise(F.length("c2"))
    between = F.substring(low, start, F.greatest(F.greatest("p1", "p2") - start, F.lit(0)))
    pair = pair.withColumn("between", between).withColumn("low", low)
    fwd = F.col("p1") < F.col("p2")
    rel = lambda f, t, kind: F.struct(F.col(f).alias("from_name"), F.col(t).alias("to_name"), F.lit(kind).alias("type"))
    either = lambda kind, cond: F.when(cond, rel("c1", "c2", kind)).otherwise(rel("c2", "c1", kind))
    said = lambda p: F.col("between").rlike(p)
    is1, is2 = (lambda x: F.col("l1") == x), (lambda x: F.col("l2") == x)
    methods = F.when(is1("Method") & is2("Dataset"), rel("c1", "c2", "EVALUATED_ON")).when(is2("Method") & is1("Dataset"), rel("c2", "c1", "EVALUATED_ON"))
    got = (
        F.when(is2("Keyword"), rel("c1", "c2", "HAS_KEYWORD"))
        .when(is1("Keyword"), rel("c2", "c1", "HAS_KEYWORD"))
        .when(said(_REQUIRES), either("PREREQUISITE_OF", ~fwd))
        .when(F.contains("low", F.lit("prerequisite")) | said(_PRECEDES), either("PREREQUISITE_OF", fwd))
        .when(said(_EXTENDS), either("EXTENDS", fwd))
        .when(said(_CONTRADICTS), rel("c1", "c2", "CONTRADICTS"))
        .when(said(_USES), F.coalesce(methods, F.when(is1("Dataset"), rel("c2", "c1", "USES")).when(is2("Dataset"), rel("c1", "c2", "USES")), either("USES", ~fwd)))
        .when(said(_EVALUATED), F.when(is1("Dataset"), rel("c2", "c1", "EVALUATED_ON")).when(is2("Dataset"), rel("c1", "c2", "EVALUATED_ON")).otherwise(rel("c1", "c2", "RELATED_TO")))
        .otherwise(F.coalesce(methods, F.when(is1("Method") & is2("Method"), rel("c1", "c2", "USES")), rel("c1", "c2", "RELATED_TO")))
    )
    return pair.select("doc_id", "chunk_no", "sent", "i", "j", got.alias("r")).select("doc_id", "chunk_no", "sent", "i", "j", "r.*")


def hub_links(found: DataFrame, rels: DataFrame) -> DataFrame:
    """``doc_id, chunk_no, from_name, to_name, type``: concepts of a chunk that have no relation with its first concept are linked to it."""
    hub = found.where("ord = 0").select("doc_id", "chunk_no", F.col("name").alias("hub"), F.col("label").alias("hub_label"))
    rest = found.where("ord > 0").join(hub, ["doc_id", "chunk_no"])
    low = F.lower
    known = rels.select("doc_id", "chunk_no", F.explode(F.array(F.struct(low("from_name").alias("a"), low("to_name").alias("b")), F.struct(low("to_name").alias("a"), low("from_name").alias("b")))).alias("e"))
    known = known.select("doc_id", "chunk_no", F.col("e.a").alias("ha"), F.col("e.b").alias("nb")).distinct()
    rest = rest.withColumn("ha", low("hub")).withColumn("nb", low("name")).join(known, ["doc_id", "chunk_no", "ha", "nb"], "left_anti")
    rel = lambda f, t, kind: F.struct(F.col(f).alias("from_name"), F.col(t).alias("to_name"), F.lit(kind).alias("type"))
    got = F.when(F.col("hub_label") == "Keyword", rel("name", "hub", "HAS_KEYWORD")).when(F.col("label") == "Keyword", rel("hub", "name", "HAS_KEYWORD")).otherwise(rel("hub", "name", "RELATED_TO"))
    return rest.select("doc_id", "chunk_no", got.alias("r")).select("doc_id", "chunk_no", "r.*")

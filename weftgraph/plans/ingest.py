"""From document text to a connected, ranked knowledge graph, as one plan partitioned by document."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import clean_documents
from ..functions.names import concept_in_text, entity_quality, normalize_name
from ..functions.text import chunks, main_topic, progress, topic_description
from ..operators import extract, ranking, resolve
from ..operators.graph import PropertyGraph
from ..operators.mutations import stable_id
from ..schema import EXTRACTION_LABELS, UTILITY_LABELS, WRITABLE_EDGE_TYPES, display_name
from ..storage import materialise

Extractor = Callable[[DataFrame], tuple[DataFrame, DataFrame]]
#: The main topic comes after all that was extracted.
_LAST = 1 << 30
# The wording of errors.
NO_TEXT = "This looks like a scanned PDF — text extraction isn't supported yet."
_POOR = "Graph extraction validation failed: %.1f%% of extracted terms are low-quality (exceeds 80%% limit). Examples of low-quality terms: %s"


def heuristic(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The offline extractor: concepts of chunks, relations with hub links."""
    found = materialise(extract.concepts(pieces), "concepts")
    rels = materialise(extract.relations(pieces, found), "relations")
    hubs = extract.hub_links(found, rels)
    cols = ["doc_id", "chunk_no", "from_name", "to_name", "type"]
    return found, rels.select(*cols).unionByName(hubs.select(*cols))


def chunk_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(chunks(F.coalesce("text", F.lit("")))).alias("c")).select("doc_id", "c.*")


def scored_names(found: DataFrame, generic: Iterable[str] | None = None) -> DataFrame:
    """Extracted nodes under their cleaned names, with ``quality``; each different name is cleaned and judged once for each label."""
    rows = found.withColumn("_raw", F.coalesce("name", F.lit(""))).withColumn("_kind", F.coalesce("label", F.lit("Concept")))
    tidy = materialise(rows.select("_raw", "_kind").distinct().withColumn("_name", normalize_name(F.col("_raw"))), "spelled", light=True)
    judged = tidy.withColumn("quality", entity_quality(F.col("_name"), F.col("_kind"), generic))
    return rows.join(judged, ["_raw", "_kind"]).withColumn("name", F.col("_name")).drop("_raw", "_kind", "_name")


def tidy_relations(rels: DataFrame) -> DataFrame:
    """Relations between cleaned names; each different name is cleaned once."""
    rows = rels.withColumn("from_name", F.coalesce("from_name", F.lit(""))).withColumn("to_name", F.coalesce("to_name", F.lit("")))
    raw = rows.select(F.explode(F.array_distinct(F.array("from_name", "to_name"))).alias("_raw")).distinct()
    tidy = materialise(raw.withColumn("_name", normalize_name(F.col("_raw"))), "tidy", light=True)
    for side in ("from_name", "to_name"):
        rows = rows.join(tidy.withColumnRenamed("_raw", side), side).withColumn(side, F.col("_name")).drop("_name")
    return rows


def verdicts(pages: DataFrame, docs: DataFrame, scored: DataFrame) -> DataFrame:
    """``doc_id, passed, error`` of every document: without text, with too many poor names, or good."""
    gate = resolve.quality_gate(scored)
    poor = scored.where("quality <= 0.7").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "ord", "name"))).alias("p"))
    some = F.array_join(F.transform(F.slice("p", 1, 5), lambda x: x["name"]), ", ")
    told = F.format_string(_POOR, F.col("low_share") * 100, some)
    rows = pages.select(F.col("doc_id").cast("string").alias("doc_id")).distinct().join(docs.select("doc_id", F.lit(True).alias("has_text")), "doc_id", "left")
    rows = rows.join(gate, "doc_id", "left").join(poor, "doc_id", "left")
    error = F.when(F.col("has_text").isNull(), F.lit(NO_TEXT)).when(~F.col("passed"), told)
    return rows.select("doc_id", error.isNull().alias("passed"), error.alias("error"))


def session_concepts(nodes: DataFrame, session_id: str) -> DataFrame:
    """What a session knows already: ``ord, label, name, description``, in order of names."""
    from pyspark.sql import Window

    own = nodes.where((F.col("session_id") == session_id) & ~F.col("label").isin(*UTILITY_LABELS))
    ord_ = F.row_number().over(Window.partitionBy("session_id").orderBy("name", "id"))
    return own.select("session_id", ord_.alias("ord"), "label", display_name(F.col("name"), F.col("title"), "").alias("name"), F.coalesce("description", F.lit("")).alias("description"))


def ingest(
    pages: DataFrame,
    session_id: str | None = None,
    extractor: Extractor = heuristic,
    keep: int = 80,
    ground: bool = True,
    known: DataFrame | None = None,
    files: DataFrame | None = None,
    generic: Iterable[str] | None = None,
) -> tuple[PropertyGraph, DataFrame]:
    """(graph, status ``doc_id, status, error``) of documents given as ``doc_id, page_no, text``.

    ``known``: nodes of graphs so far; those of the session lead the clusters, so their names and ids are kept. ``files``: ``doc_id, filename``
    (the id where there is none). Documents without text, or with too many poor names, fail and add nothing. Each document is connected: parts without
    a link to its main topic get one, and a document without a paper is represented by one.
    """
    pages = pages.withColumn("doc_id", F.col("doc_id").cast("string"))
    docs = clean_documents(pages)
    names = files.select(F.col("doc_id").cast("string").alias("doc_id"), "filename") if files is not None else pages.select("doc_id", F.col("doc_id").alias("filename")).distinct()
    docs = materialise(docs.join(names, "doc_id", "left").withColumn("filename", F.coalesce("filename", "doc_id")), "clean")
    pieces = materialise(chunk_rows(docs), "chunks")
    found, rels = extractor(pieces)
    scored = materialise(scored_names(found, generic), "scored")
    gate = materialise(verdicts(pages, docs, scored), "gate", light=True)
    passed = gate.where("passed").select("doc_id")
    good = scored.where("quality > 0.7").join(passed, "doc_id", "left_semi")
    docs = docs.join(passed, "doc_id", "left_semi")

    # clusters: what the session knows, then what was extracted, then the main topic
    cols = ["doc_id", "ord", "label", "name", "description", "is_existing"]
    mentions = good.select("doc_id", (F.col("chunk_no") * 1000 + F.col("ord")).cast("int").alias("ord"), "label", "name", "description", F.lit(False).alias("is_existing"))
    sample, file = F.col("text"), F.col("filename")
    # what is told from whole texts, and read more than once, is stored: else each reading takes the texts again
    central = docs.select("doc_id", F.lit(_LAST).alias("ord"), F.lit("Topic").alias("label"), main_topic(sample, file).alias("name"), topic_description(sample, file).alias("description"), F.lit(False).alias("is_existing"))
    every = mentions.unionByName(materialise(central, "central"))
    if known is not None and session_id is not None:
        # each document of a session sees the concepts of that session
        before = session_concepts(known, session_id).join(docs.select("doc_id", F.lit(session_id).alias("session_id")), "session_id")
        every = every.unionByName(before.withColumn("is_existing", F.lit(True)).select(*cols))
    clustered = materialise(resolve.leader_clusters(every), "clusters")
    canonical = materialise(resolve.canonical_nodes(clustered), "canonical")
    mapping = materialise(resolve.name_mapping(clustered, canonical), "mapping")
    topics = clustered.where(F.col("ord") == _LAST).where("not is_existing").select("doc_id", "cluster", F.lit(True).alias("central"))
    canonical = canonical.join(topics, ["doc_id", "cluster"], "left").withColumn("central", F.coalesce("central", F.lit(False)))
    if ground:
        canonical = grounded(canonical, docs)
    canonical = materialise(resolve.enrich(canonical, docs).join(topics, ["doc_id", "cluster"], "left").withColumn("central", F.coalesce("central", F.lit(False))), "enriched")

    # ranking
    rels = tidy_relations(rels.join(passed, "doc_id", "left_semi"))
    links = materialise(resolve.canonical_relations(rels, mapping), "links")
    degree = links.select("doc_id", F.explode(F.array("from_name", "to_name")).alias("name")).groupBy("doc_id", "name").agg(F.count("*").alias("degree"))
    freq = resolve.name_frequency(clustered.where("not is_existing"), mapping)
    weights = materialise(ranking.tfidf(canonical.select("doc_id", "name").distinct(), docs).select("doc_id", "name", "tfidf"), "weights")
    ranked = canonical.join(weights, ["doc_id", "name"], "left").join(degree, ["doc_id", "name"], "left").join(freq, ["doc_id", "name"], "left")
    ranked = ranked.fillna(0, ["tfidf", "degree", "freq"]).withColumn("ord", F.col("cluster"))
    top = ranking.top_concepts(ranked, keep).unionByName(ranked.where("central").select("*", F.lit(0.0).alias("score"), F.lit(0).alias("rank")))
    label = F.when(F.col("label").isin(*EXTRACTION_LABELS), F.col("label")).otherwise("Concept")
    top = materialise(top.dropDuplicates(["doc_id", "cluster"]).select("doc_id", "cluster", "name", label.alias("label"), "description", "central", F.lower(F.trim("name")).alias("key")), "ranked")

    # one node for each name of a document, the earliest cluster's
    nodes = materialise(resolve.first_wins(top, ["doc_id", "key"], [F.desc("central"), "cluster"]), "nodes")
    edges = links.select("doc_id", F.lower(F.trim("from_name")).alias("src"), F.lower(F.trim("to_name")).alias("dst"), "type")
    keys = nodes.select("doc_id", "key")
    edges = edges.join(keys.withColumnRenamed("key", "src"), ["doc_id", "src"], "left_semi").join(keys.withColumnRenamed("key", "dst"), ["doc_id", "dst"], "left_semi")
    edges = materialise(edges.distinct(), "edges")
    edges = materialise(edges.unionByName(stitches(nodes, edges)), "stitched")
    papers, mentions = anchors(nodes, edges, docs)
    nodes, edges = nodes.unionByName(papers), edges.unionByName(mentions)
    return _written(nodes, edges, docs, session_id, known), gate.select("doc_id", F.when(F.col("passed"), "done").otherwise("error").alias("status"), "error")


def grounded(canonical: DataFrame, docs: DataFrame) -> DataFrame:
    """Canonical nodes whose name stands in the text of their document, and main topics; one row of a document carries the text to all its nodes."""
    kinds = canonical.drop("doc_id").columns
    grouped = canonical.groupBy("doc_id").agg(F.collect_list(F.struct(*kinds)).alias("nodes"))
    kept = F.filter("nodes", lambda x: x["central"] | concept_in_text(x["name"], F.col("text")))
    return grouped.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.explode(kept).alias("x")).select("doc_id", "x.*")


def _neighbours(edges: DataFrame) -> DataFrame:
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return edges.select("doc_id", both.alias("e")).groupBy("doc_id", F.col("e.src").alias("key")).agg(F.count_distinct("e.dst").alias("deg"))


def stitches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``doc_id, src, dst, type``: from the main topic of each document to the best-connected member of every part that has no link to it."""
    one = lambda c: stable_id(F.col("doc_id"), F.col(c))
    local = PropertyGraph(nodes.select(one("key").alias("id"), "doc_id", "key", "cluster", "central"), edges.select(one("src").alias("src"), one("dst").alias("dst"), "type"))
    comp = materialise(local.nodes.join(local.components(), "id"), "components")
    member = comp.join(_neighbours(edges), ["doc_id", "key"], "left").groupBy("doc_id", "component")
    member = member.agg(F.min_by("key", F.struct(-F.coalesce("deg", F.lit(0)), "cluster")).alias("dst"))
    home = comp.where("central").select("doc_id", F.col("component").alias("home"), F.col("key").alias("src"))
    return member.join(home, "doc_id").where("component != home").select("doc_id", "src", "dst", F.lit("RELATED_TO").alias("type"))


def anchors(nodes: DataFrame, edges: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paper nodes, MENTIONS edges) of documents without a paper: titled from the file, linked to the best-connected concept."""
    # The wording of titles and descriptions, the labels that can be an anchor.
    title = F.trim(F.regexp_replace(F.regexp_replace("filename", "^[0-9a-fA-F-]{36}_", ""), "(?i)\\.pdf$", ""))
    has = nodes.where("label = 'Paper'").select("doc_id").distinct()
    bare = docs.join(has, "doc_id", "left_anti").join(nodes.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", title.alias("title"))
    name = F.when(F.col("title") == "", "Uploaded Research Paper").otherwise(F.col("title"))
    about = F.concat(F.lit("Source research paper for the extracted knowledge graph: "), "title", F.lit("."))
    paper = bare.select("doc_id", F.lit(_LAST).alias("cluster"), name.alias("name"), F.lit("Paper").alias("label"), about.alias("description"), F.lit(False).alias("central"), F.concat(F.lit("paper:"), F.lower(F.trim(name))).alias("key"))
    able = nodes.where(F.col("label").isin("Topic", "Concept", "Method", "Dataset")).join(_neighbours(edges), ["doc_id", "key"], "left")
    best = able.groupBy("doc_id").agg(F.min_by("key", F.struct(-F.coalesce("deg", F.lit(0)), "cluster")).alias("dst"))
    return paper, paper.select("doc_id", F.col("key").alias("src")).join(best, "doc_id").select("doc_id", "src", "dst", F.lit("MENTIONS").alias("type"))


def _written(nodes: DataFrame, edges: DataFrame, docs: DataFrame, session_id: str | None, known: DataFrame | None) -> PropertyGraph:
    """Names become ids: of a session one node for each name, else one for each name of a document; papers are a family of their own."""
    none = F.lit(None).cast("string")
    session = F.lit(session_id).cast("string").alias("session_id")
    scope = F.lit(session_id) if session_id is not None else F.col("doc_id")
    family = F.when(F.col("label") == "Paper", F.concat(F.lit("paper:"), F.lower(F.trim("name")))).otherwise(F.lower(F.trim("name")))
    ids = nodes.withColumn("own", family).withColumn("id", stable_id(scope, F.col("own")))
    if known is not None and session_id is not None:
        there = known.where((F.col("session_id") == session_id) & ~F.col("label").isin(*UTILITY_LABELS)).groupBy(family.alias("own")).agg(F.min("id").alias("_there"))
        ids = ids.join(there, "own", "left").withColumn("id", F.coalesce("_there", "id")).drop("_there")
    ids = materialise(ids, "ids")
    rows = ids.select(
        "id", "label", F.trim("name").alias("name"), F.when(F.col("label") == "Paper", F.trim("name")).alias("title"), "description", F.lit("Beginner").alias("difficulty_level"), "doc_id", session
    )
    rows = resolve.first_wins(rows, ["id"], ["doc_id", "name"])
    place = ids.select("doc_id", "key", "id")
    kinds = F.when(F.col("type").isin(*WRITABLE_EDGE_TYPES), F.col("type")).otherwise("RELATED_TO")
    out = edges.join(place.select("doc_id", F.col("key").alias("src"), F.col("id").alias("a")), ["doc_id", "src"]).join(place.select("doc_id", F.col("key").alias("dst"), F.col("id").alias("b")), ["doc_id", "dst"])
    out = out.select(F.col("a").alias("src"), F.col("b").alias("dst"), kinds.alias("type"), "doc_id", session).distinct()
    doc_nodes = docs.select("doc_id", "filename").select(
        F.col("doc_id").alias("id"), F.lit("Document").alias("label"), none.alias("name"), F.col("filename").alias("title"), none.alias("description"), none.alias("difficulty_level"), none.alias("doc_id"), session
    )
    holds = ids.select(F.col("doc_id").alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("type"), none.alias("doc_id"), none.alias("session_id")).distinct()
    return PropertyGraph(rows.unionByName(doc_nodes), out.unionByName(holds))


def status_events(docs: DataFrame, pieces: DataFrame, status: DataFrame) -> DataFrame:
    """``doc_id, seq, status, progress_pct, error`` as a run tells them: 10 received, 30 read, 40 cut, then chunk by chunk to 90, 100 at the end."""
    step = lambda df, seq, pct: df.select("doc_id", F.lit(seq).cast("long").alias("seq"), F.lit("processing").alias("status"), F.lit(pct).alias("progress_pct"), F.lit(None).cast("string").alias("error"))
    n = pieces.groupBy("doc_id").agg(F.count("*").alias("n"))
    chunk = pieces.select("doc_id", "chunk_no").join(n, "doc_id")
    chunk = chunk.select("doc_id", (F.col("chunk_no") + 3).cast("long").alias("seq"), F.lit("processing").alias("status"), progress(F.col("chunk_no"), F.col("n")).alias("progress_pct"), F.lit(None).cast("string").alias("error"))
    end = status.select("doc_id", F.lit(1 << 40).cast("long").alias("seq"), "status", F.lit(100).alias("progress_pct"), "error")
    return step(status, 0, 10).unionByName(step(docs, 1, 30)).unionByName(step(docs, 2, 40)).unionByName(chunk).unionByName(end)

"""Scalar truth tables, cleaning, clustering and sequences."""

import pytest
from plain_names import Name
from pyspark.sql import functions as F

from weftgraph.functions import cleaning, names, text
from weftgraph.operators import library, resolve, sequences
from weftgraph.plans import ingest

_PAIRS = [("Attention", "Attention Mechanism"), ("self-attention", "self attention mechanism"), ("Neural Networks", "Neural Network"), ("Deep Learning", "deep neural network"), ("Calculus", "Vector Calculus"), ("Zero Knowledge Proof", "Zero-Knowledge Proofs"), ("IPFS", "InterPlanetary File System"), ("GCN", "Graph Convolutional Network")]
_SEQ_TEXT = "# Phase 2.10: Graph Theory Basics\n- Phase 2.2: Matrix Operations\nPhase 1: Linear Algebra\nsome prose in between\n1. Vector Spaces\n2. Inner Products\nprose does not break a run\n3. Orthogonal Bases\n- bullet\n2. Lost Item\nLinear Maps -> Eigenvalue Methods -> Spectral Clustering → Kernel Tricks\n"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("pair,want", list(zip(_PAIRS, [True, True, True, False, True, True, False, True], strict=True)))
def test_similar(spark, pair, want):
    assert one(spark, names.similar_names(F.lit(pair[0]), F.lit(pair[1]))) is want
    assert Name(pair[0]).like(Name(pair[1])) is want


@pytest.mark.parametrize("word,want", [("Proofs", "Proof"), ("Theories", "Theory"), ("Matrices", "Matrex"), ("Services", "Servex"), ("Databases", "Databas"), ("Class", "Class"), ("Calculus", "Calculus")])
def test_singularize(spark, word, want):
    assert one(spark, names.singularize(F.lit(word))) == want


@pytest.mark.parametrize("name,low", [("Lorem", True), ("Page 1", True), ("Test Test Test", True), ("XYZ123XYZ", True), ("abc", True), ("xyz qwe", True), ("Valid Concept One", False), ("DFA", False), ("The", True)])
def test_quality(spark, name, low):
    assert (one(spark, names.entity_quality(F.lit(name), F.lit("Concept"))) <= 0.7) is low
    assert one(spark, names.entity_quality(F.lit("Valid Concept One"), F.lit("Institution"))) == 0.0


@pytest.mark.parametrize("n,want", [(0, 0), (1, 1), (6000, 1), (6001, 2), (11200, 2), (11201, 3), (13000, 3)])
def test_chunks(spark, n, want):
    got = one(spark, text.chunks(F.lit("x" * n)))
    assert len(got) == want
    assert want == 0 or (got[0]["chunk"] == "x" * min(n, 6000) and sum(len(c["chunk"]) for c in got) == n + 800 * (want - 1))


def test_progress(spark):
    assert [one(spark, text.progress(F.lit(i), F.lit(4))) for i in range(4)] == [52, 65, 77, 90]


def test_citation(spark):
    none = F.array().cast("array<string>")
    make = lambda style, authors: one(spark, text.citation(F.lit(style), authors, F.lit(None), F.lit("T"), F.lit("")))
    assert make("apa", none) == "Unknown Author. (n.d.). T. https://doi.org/"
    assert make("APA", F.array(F.lit("A"), F.lit("B"))).startswith("A & B. ")
    assert make("MLA", F.array(F.lit("A"), F.lit("B"), F.lit("C"))).startswith("A, et al.")


def test_names(spark):
    assert one(spark, names.normalize_name(F.lit('  "the state-of-the-art DFA models of the," '))) == "State-Of-The-Art DFA Model"
    assert one(spark, names.title_case(F.lit("o'neil x1y"))) == "O'Neil X1Y"
    assert one(spark, names.concept_in_text(F.lit("Theory"), F.lit("many theories here"))) is True
    assert one(spark, names.concept_in_text(F.lit("art"), F.lit("party"))) is False
    assert one(spark, names.relation_type(F.lit("use-for"))) == "USED_FOR"
    assert one(spark, text.repair_json(F.lit('```json\n{"nodes": [], "relationships": []}\n```'))) is not None
    assert one(spark, text.repair_json(F.lit("no json"))) is None
    assert one(spark, text.file_stem_title(F.lit("deep_learning-notes.v2.pdf"))) == "Deep Learning Notes.V2"
    assert one(spark, text.ellipsis(F.lit("x" * 400), 300)) == "x" * 297 + "..."


def test_cleaning(spark):
    own = ("alpha", "bravo", "delta")
    page = "Header Line 1\nOpening with WORD\nMore of WORD\nThe para-\ngraph goes on\nand on.\n\n12\nPage 3\nspam spam spam spam\n- item one\n- item two\n- last WORD\n- final WORD\nCopyright 2020 Someone"
    pages = spark.createDataFrame([(1, i, page.replace("Line 1", f"Line {i}").replace("WORD", w)) for i, w in enumerate(own)], "doc_id long, page_no int, text string")
    got = [r["text"] for r in cleaning.clean_pages(pages).orderBy("page_no").collect()]
    assert all("Header" not in t and "Copyright" not in t and "spam" not in t and "12" not in t for t in got)
    assert "The paragraph goes on and on." in got[0] and "\n- item two\n- last alpha" in got[0]
    whole = cleaning.clean_documents(pages).first()["text"]
    assert whole == "\n\n".join(got)
    assert cleaning.clean_documents(pages.where("false")).count() == 0


def test_respace():
    assert cleaning.respace("S E L L I N G in InterconnectedLANs") == "SELLING in Interconnected LANs"
    assert cleaning.respace("a neuralnetwork and at tention.Next") == "a neural network and attention. Next"


def test_clusters(spark):
    rows = [("Attention", "one"), ("Attention Mechanism", "two"), ("Self-Attention", "three"), ("self attention mechanism", "one"), ("Neural Networks", "n"), ("neural net", "m"), ("Transformer Architecture", "t"), ("ZKP", "z")]
    m = spark.createDataFrame([("d", i, "Concept", n, x, False) for i, (n, x) in enumerate(rows)], "doc_id string, ord int, label string, name string, description string, is_existing boolean")
    c = resolve.leader_clusters(m)
    groups = {}
    for r in c.collect():
        groups.setdefault(r["cluster"], set()).add(r["name"])
    assert {"Attention", "Attention Mechanism", "self attention mechanism"} in groups.values() and {"Self-Attention"} in groups.values() and len(groups) == 5
    canon = {r["cluster"]: (r["name"], r["description"]) for r in resolve.canonical_nodes(c).collect()}
    assert canon[0] == ("self attention mechanism", "one two")
    mapping = {r["key"]: r["canonical"] for r in resolve.name_mapping(c, resolve.canonical_nodes(c)).collect()}
    assert mapping["attention"] == "self attention mechanism"


def test_enrich():
    said = resolve.describe("Graph", "", "Short. A graph is a set of vertices joined by edges in pairs that matter. End.")
    assert said == "A graph is a set of vertices joined by edges in pairs that matter."
    assert resolve.describe("Nowhere", "", "Nothing.") == "Key concept of Nowhere extracted from the document."


def test_sequences(spark):
    docs = spark.createDataFrame([(1, _SEQ_TEXT), (2, "no list"), (3, None)], "doc_id long, text string")
    nodes, rels = sequences.parse_sequences(docs)
    pairs = {(r["from_name"], r["to_name"]) for r in rels.collect()}
    assert {("Linear Algebra", "Matrix Operation"), ("Vector Spac", "Inner Product"), ("Eigenvalue Method", "Spectral Clustering")} <= pairs
    assert not any("Lost" in a + b for a, b in pairs)
    assert nodes.where("doc_id != 1").count() == 0


def test_mentions(spark):
    texts = spark.createDataFrame([(1, "About RED widgets"), (2, ""), (3, None)], "text_id long, text string")
    known = spark.createDataFrame([("red widget",), ("ab",), ("zz top",)], "name string")
    assert {tuple(r) for r in library.concept_mentions(texts, known).collect()} == {(1, "red widget"), (1, "ab")}


def test_ingest_connects_and_gates(spark):
    good = "Gradient Descent requires Linear Algebra. Backpropagation uses Gradient Descent. The Chain Rule extends Calculus.\nBoltzmann Machines were early generative networks of binary units that learn slowly."
    pages = spark.createDataFrame([("a", 0, good), ("b", 0, "Lorem Test Abc. Xyz Foo.\nBar Baz Qwe.")], "doc_id string, page_no int, text string")
    graph, status = ingest.ingest(pages, "s1")
    got = {r["doc_id"]: r["status"] for r in status.collect()}
    assert got["a"] == "done"
    mine = graph.session("s1").nodes.where("doc_id = 'a'")
    assert mine.where("name = 'Gradient Descent'").count() == 1
    comp = type(graph)(mine, graph.edges).components()
    assert comp.select("component").distinct().count() == 1


def test_general_terms_are_no_concepts(spark):
    terms = names.general_terms()
    assert len(terms) == 491 and terms[0] == "something" and terms[-1] == "figure 3"
    given = ["Homework", "Discussion", "Academic", "Neural Network", "Backpropagation"]
    rows = spark.createDataFrame([(x,) for x in (*given, *terms)], "name string")
    scored = rows.select("name", F.lower(names.normalize_name(F.col("name"))).alias("low"), names.entity_quality(F.col("name"), F.lit("Concept")).alias("q")).collect()
    # plurals are cut crudely before they are looked up, so some ("lectur") are not found
    assert sum(r["low"] in terms for r in scored) > 350 and all(r["q"] == 0 for r in scored if r["low"] in terms)
    assert [r["name"] for r in scored if r["name"] in given and r["q"] > 0.7] == given[-2:]
    own = rows.select(names.entity_quality(F.lit("Homework"), F.lit("Concept"), []).alias("q")).first()["q"]
    assert own == 1.0

"""Ingest against a plain program, documents isolated from one another, sessions merged, uploads with their states."""

import math
import re

import pytest
from plain_names import Name
from pyspark.sql import functions as F

from weftgraph.functions.cleaning import clean_documents
from weftgraph.functions.text import chunks
from weftgraph.operators import client, resolve
from weftgraph.plans import ingest, upload
from weftgraph.sources.blobs import BlobStore, pdf_pages, text_pages

ML = "Gradient Descent requires Linear Algebra. Backpropagation uses Gradient Descent. The Chain Rule extends Calculus.\nBoltzmann Machines were early generative networks of binary units that learn slowly from data.\nLinear Algebra is a theory of vector spaces and of the linear maps between them which is old."
AUTOMATA = "Finite Automata precedes Regular Grammar. A Turing Machine extends Finite Automata and Pushdown Stores.\nRegular Grammar is a set of rules that describe the words of a regular language in full."


def pages_of(spark, **texts):
    return spark.createDataFrame([(d, 0, t) for d, t in texts.items()], "doc_id string, page_no int, text string")


def brute(spark, text, found, rels, topic):
    """Names, edges by name, and the anchor of one document outside a session, step by step on lists."""
    tidy = lambda n: spark.range(1).select(ingest.normalize_name(F.lit(n))).first()[0]
    score = lambda n, label: spark.range(1).select(ingest.entity_quality(F.lit(n), F.lit(label))).first()[0]
    nodes = [(tidy(r["name"]), r["label"], (r["description"] or "")) for r in found]
    nodes = [n for n in nodes if score(n[0], n[1]) > 0.7] + [(topic[0], "Topic", topic[1])]
    clusters = []
    for n in nodes:
        own = next((c for c in clusters if Name(n[0]).like(Name(c[0][0]))), None)
        clusters.append([n]) if own is None else own.append(n)
    order = ["Topic", "Paper", "Author", "Concept", "Keyword"]
    rank = lambda x: order.index(x[1]) if x[1] in order else 99
    reps, names = [], {}
    for c in clusters:
        rep = c[0]
        for n in c:
            if rank(n) < rank(rep) or (rank(n) == rank(rep) and (len(n[0]) > len(rep[0]) or (n[0].istitle() and not rep[0].istitle()))):
                rep = n
        reps.append(rep)
        names.update({n[0].lower(): rep[0] for n in c})

    def said(n):
        end = n[:-1] + "(y|ies)" if n.lower().endswith("y") else n if n.lower().endswith("s") else n + "(s|es)?"
        return re.search(rf"\b{end}\b", text, re.I)

    home = names[topic[0].lower()]
    reps = [r for r in reps if said(r[0]) or r[0] == home]
    links = []
    for a, b, t in rels:
        x, y = names.get(tidy(a).lower(), tidy(a)), names.get(tidy(b).lower(), tidy(b))
        if x.lower() != y.lower() and (x, y, t) not in links:
            links.append((x, y, t))
    pieces = [c["chunk"].lower() for c in spark.range(1).select(chunks(F.lit(text))).first()[0]]

    def weight(r):
        name, low = r[0], r[0].lower()
        degree = sum((x == name) + (y == name) for x, y, _ in links)
        often = sum(names[n[0].lower()] == name for n in nodes)
        df = sum(low in p for p in pieces)
        return (text.lower().count(low) * (math.log((1 + len(pieces)) / (1 + df)) + 1) + 5 * degree + 10 * often) * (1.5 if " " in name or re.fullmatch("[A-Z]{2,6}", name) else 1.0)

    ranked = sorted((r for r in reps if r[1] in ("Concept", "Keyword", "Method", "Dataset")), key=weight, reverse=True)[:80]
    kept = [r for r in reps if r in ranked or r[1] not in ("Concept", "Keyword", "Method", "Dataset")]
    keep = {r[0].lower() for r in kept}
    links = [e for e in links if e[0].lower() in keep and e[1].lower() in keep]
    near = {r[0]: set() for r in kept}
    for x, y, _ in links:
        near[x].add(y), near[y].add(x)
    part = {}
    for r in kept:
        if r[0] not in part:
            todo = [r[0]]
            while todo:
                n = todo.pop()
                if n not in part:
                    part[n] = r[0]
                    todo += near[n]
    for p in {part[r[0]] for r in kept} - {part[home]}:
        member = min((r[0] for r in kept if part[r[0]] == p), key=lambda n: (-len(near[n]), [r[0] for r in reps].index(n)))
        links.append((home, member, "RELATED_TO"))
    for x, y, t in links:
        if t == "RELATED_TO" and x == home:
            near[x].add(y), near[y].add(x)
    able = [r[0] for r in kept if r[1] in ("Topic", "Concept", "Method", "Dataset")]
    anchor = min(able, key=lambda n: (-len(near[n]), [r[0] for r in reps].index(n)))
    return {r[0] for r in kept}, {(x, y, "RELATED_TO" if t == "CONTAINS" else t) for x, y, t in links}, anchor


@pytest.mark.parametrize("text", [ML, AUTOMATA, ML + "\n" + AUTOMATA])
def test_ingest_equals_a_plain_program(spark, text):
    pages = pages_of(spark, a=text)
    graph, status = ingest.ingest(pages)
    assert [tuple(r) for r in status.collect()] == [("a", "done", None)]
    clean = clean_documents(pages).first()["text"]
    found, rels = ingest.heuristic(ingest.chunk_rows(clean_documents(pages)))
    found = found.orderBy("chunk_no", "ord").collect()
    kind = lambda t: {"USES": "USES", "HAS_KEYWORD": "HAS_KEYWORD", "PREREQUISITE_OF": "PREREQUISITE_OF", "EXTENDS": "EXTENDS", "EVALUATED_ON": "EVALUATED_ON"}.get(t, "RELATED_TO")
    rels = [(r["from_name"], r["to_name"], kind(r["type"])) for r in rels.collect()]
    names, links, anchor = brute(spark, clean, found, rels, ("A", "Unified knowledge map and conceptual analysis of the document a."))
    by_id = {r["id"]: r["name"] for r in graph.nodes.where("label not in ('Document', 'Paper')").collect()}
    assert set(by_id.values()) == names
    papers = {r["id"]: r["name"] for r in graph.nodes.where("label = 'Paper'").collect()}
    assert list(papers.values()) == ["a"]
    edges = graph.edges.where("type != 'CONTAINS'").collect()
    assert {(by_id[r["src"]], by_id[r["dst"]], r["type"]) for r in edges if r["src"] in by_id} == links
    assert [(r["type"], by_id[r["dst"]]) for r in edges if r["src"] in papers] == [("MENTIONS", anchor)]
    assert {r["dst"] for r in graph.edges.where("type = 'CONTAINS'").collect()} == set(by_id) | set(papers)


def test_documents_are_isolated_and_failures_leave_nothing(spark):
    graph, status = ingest.ingest(pages_of(spark, a=ML, b=AUTOMATA, c="Chapter Test goes on here. Section Dummy stays at home.\nFigure Spam falls from above.", d=""))
    state = {r["doc_id"]: (r["status"], r["error"]) for r in status.collect()}
    assert state["a"] == state["b"] == ("done", None) and state["d"] == ("error", ingest.NO_TEXT)
    assert state["c"][0] == "error" and "exceeds 80% limit" in state["c"][1] and "Chapter Test" in state["c"][1]
    names = {d: {r["name"] for r in graph.nodes.where(f"doc_id = '{d}'").collect()} for d in "abcd"}
    assert "Linear Algebra" in names["a"] and "Regular Grammar" in names["b"] and not names["a"] & names["b"] and not names["c"] | names["d"]
    assert graph.edges.where("doc_id in ('c', 'd')").count() == 0 and graph.nodes.where("id in ('c', 'd')").count() == 0
    for d in "ab":
        own = type(graph)(graph.nodes.where(f"doc_id = '{d}'"), graph.edges)
        assert own.components().select("component").distinct().count() == 1


def test_sessions_merge(spark):
    first, _ = ingest.ingest(pages_of(spark, a=ML), "s1")
    old = {r["name"]: r["id"] for r in first.session("s1").nodes.where("label != 'Document'").collect()}
    second, _ = ingest.ingest(pages_of(spark, b="Linear Algebra precedes Spectral Theory. Gradient Descents uses Spectral Theory."), "s1", known=first.nodes)
    new = {r["name"]: r["id"] for r in second.session("s1").nodes.where("label != 'Document'").collect()}
    assert new["Linear Algebra"] == old["Linear Algebra"] and new["Gradient Descent"] == old["Gradient Descent"] and "Gradient Descents" not in new
    assert {r["dst"] for r in second.edges.where("src = 'b' and type = 'CONTAINS'").collect()} >= {old["Linear Algebra"], new["Spectral Theory"]}


def test_extractor_of_single_chunks_skips_what_fails(spark):
    def extract(text):
        if "Automata" in text:
            raise ValueError("no answer")
        return {"nodes": [{"label": "Concept", "name": "the Linear Algebras", "description": ""}, {"label": "Method", "name": "Gradient Descent", "description": ""}], "relationships": [{"from": "Gradient Descent", "to": "Linear Algebra", "type": "requires"}]}

    graph, status = ingest.ingest(pages_of(spark, a=ML, b=AUTOMATA), extractor=client.extractor(extract))
    assert {r["doc_id"]: r["status"] for r in status.collect()} == {"a": "done", "b": "done"}
    assert {r["name"] for r in graph.nodes.where("doc_id = 'a' and label != 'Paper'").collect()} == {"Linear Algebra", "Gradient Descent", "A"}
    assert {r["name"] for r in graph.nodes.where("doc_id = 'b' and label != 'Paper'").collect()} == {"B"}


def test_upload(spark, tmp_path):
    store = BlobStore(spark, f"file://{tmp_path}/store")
    params = {"suffix": ".txt", "reader": text_pages}
    with pytest.raises(ValueError):
        upload.upload(store, upload.empty_graph(spark), "a.doc", b"x", **params)
    one = upload.upload(store, upload.empty_graph(spark), "ml.txt", ML.encode(), "s1", doc_id="d1", **params)
    pct = [r["progress_pct"] for r in one.events.orderBy("seq").collect()]
    assert pct == sorted(pct) and pct[0] == 10 and pct[-1] == 100 and 30 in pct and 40 in pct
    two = upload.upload(store, one.graph, "au.txt", AUTOMATA.encode(), "s1", doc_id="d2", **params)
    assert {r["id"]: r["status"] for r in two.graph.documents("s1").collect()} == {"d1": "done", "d2": "done"}
    assert store.download("documents", "d1_ml.txt") == ML.encode()
    with pytest.raises(PermissionError):
        upload.upload(store, two.graph, "x.txt", b"x", "s2", replace_doc_id="d1", **params)
    with pytest.raises(KeyError):
        upload.remove_document(store, two.graph, "nowhere")
    bad = upload.upload(store, two.graph, "bad.txt", b"Chapter Test goes on here. Section Dummy stays at home.", "s1", replace_doc_id="d1", doc_id="d3", **params)
    with pytest.raises(FileNotFoundError):
        store.download("documents", "d1_ml.txt")
    assert {r["id"]: r["status"] for r in bad.graph.documents("s1").collect()} == {"d2": "done", "d3": "error"}
    assert bad.graph.nodes.where("doc_id in ('d1', 'd3')").count() == 0 and bad.events.orderBy(F.desc("seq")).first()["status"] == "error"
    alone = upload.upload(store, bad.graph, "ml.txt", ML.encode(), doc_id="d4", **params)
    assert {r["id"] for r in alone.graph.nodes.where("label = 'Document'").collect()} == {"d4"}
    with pytest.raises(FileNotFoundError):
        store.download("documents", "d2_au.txt")
    assert upload.remove_session(store, two.graph, "s1").nodes.count() == 0


def test_unreadable_blobs_say_so(spark, tmp_path):
    pytest.importorskip("pypdf", reason="the reader is optional")
    store = BlobStore(spark, f"file://{tmp_path}/b")
    store.upload("documents", "x.pdf", b"no pdf at all")
    row = pdf_pages(store.read("documents")).first()
    assert row["page_no"] is None and row["error"]

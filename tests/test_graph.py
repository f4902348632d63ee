"""Known answers on the seed graph, and invariants of traversal, stitching and mutations."""

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import mutations as M
from weftgraph.operators.graph import PropertyGraph, narration, path_edges
from weftgraph.sources.seed import seed_graph


@pytest.fixture(scope="module")
def g(spark):
    return seed_graph(spark)


def test_shape(g):
    assert g.nodes.count() == 41 and g.edges.count() == 44
    assert g.components().select("component").distinct().count() == 1
    assert g.isolated().count() == 0


@pytest.mark.parametrize(
    "target,depth,nodes,edges",
    [("neural-networks", 1, 3, 2), ("neural-networks", 2, 5, 5), ("neural-networks", 3, 5, 5), ("gradient-descent", 3, 3, 2), ("transformers", 2, 4, 3), ("transformers", 3, 5, 4)],
)
def test_expand(g, target, depth, nodes, edges):
    n, e = g.expand(f"c-{target}", depth)
    assert (n.count(), e.count()) == (nodes, edges)


def test_expand_grows(g):
    seen = set()
    for d in (1, 2, 3):
        now = {r["id"] for r in g.expand("c-cnns", d, "advanced")[0].collect()}
        assert seen <= now
        seen = now
    with pytest.raises(ValueError):
        g.expand("c-cnns", 4)
    assert g.expand("nobody", 1)[0].count() == 0


@pytest.mark.parametrize(
    "target,kw,hops,start",
    [
        ("feedforward-networks", {}, 5, None), ("neural-networks", {}, 2, None), ("transformers", {}, 1, "c-positional-encoding"), ("transformers", {"prefer_root": False}, 5, None),
        ("transformers", {"prefer_root": False, "max_hops": 13}, 12, None), ("bert-gpt", {}, 3, "c-positional-encoding"), ("regularization", {}, 2, "c-probability-stats"), ("linear-algebra", {}, 0, "c-linear-algebra"),
    ],
)
def test_learning_path(g, target, kw, hops, start):
    row = g.learning_path(f"c-{target}", **kw).first()
    assert row["hops"] == hops and row["path"][-1] == f"c-{target}"
    assert start is None or row["path"][0] == start


@pytest.mark.parametrize("a,b,hops", [("c-linear-algebra", "c-transformers", 8), ("p-gcn", "a-ashish-vaswani", 2), ("c-calculus", "c-gnns", 6), ("c-cnns", "c-cnns", 0)])
def test_shortest_path(g, a, b, hops):
    assert len(g.shortest_path(a, b)) == hops + 1


def test_no_path(spark, g):
    lone = PropertyGraph(g.nodes, g.edges.where("false"))
    assert lone.shortest_path("c-cnns", "c-gnns") == []


def test_narration_and_edges(spark):
    df = spark.createDataFrame([(["A", "B", "C"],), (["A"],), ([],)], "path array<string>")
    said = [r[0] for r in df.select(narration(F.col("path"))).collect()]
    assert said[0].startswith("First") and "Next, transition into **B**" in said[0] and said[0].endswith("**C**.")
    assert said[1].startswith("First") and said[2].startswith("No prerequisite")
    assert [(r["src"], r["dst"]) for r in path_edges(df).orderBy("pos").collect()] == [("A", "B"), ("B", "C")]


def test_stitch_connects(spark):
    nodes = spark.createDataFrame([(x, "Concept", x, None, None, None, None, "s") for x in "abcde"], "id string, label string, name string, title string, description string, difficulty_level string, doc_id string, session_id string")
    edges = spark.createDataFrame([("a", "b", "USES", None, "s"), ("c", "d", "USES", None, "s")], "src string, dst string, type string, doc_id string, session_id string")
    g = PropertyGraph(nodes, edges)
    extra = g.stitch("a")
    assert {(r["src"], r["dst"]) for r in extra.collect()} == {("a", "c"), ("a", "e")}
    none = F.lit(None).cast("string")
    whole = PropertyGraph(nodes, edges.unionByName(extra.select("src", "dst", "type", none.alias("doc_id"), none.alias("session_id"))))
    assert whole.components().select("component").distinct().count() == 1


def test_document_scope(spark):
    g = seed_graph(spark, "doc-1", "s1")
    assert (g.nodes.count(), g.edges.count()) == (45, 91)
    assert g.members("doc-1").count() == 44
    assert g.document("doc-1").edges.count() == 47
    assert g.node("p-gcn").first()["name"] == "Semi-Supervised Classification with Graph Convolutional Networks"
    assert g.nodes.where("year = 2014").count() == 2 and g.nodes.where("difficulty_level = 'Advanced'").count() == 13
    asked = spark.createDataFrame([("c-cnns",), ("nobody",)], "id string")
    assert {r["id"]: r["status"] for r in g.ownership(asked, "s1").collect()} == {"c-cnns": "OK", "nobody": "NOT_FOUND"}
    assert g.ownership(asked, "s2").where("id = 'c-cnns'").first()["status"] == "FORBIDDEN"


def test_cascade(spark):
    cols = "id string, label string, name string, title string, description string, difficulty_level string, doc_id string, session_id string"
    rows = [("d1", "Document"), ("p1", "Paper"), ("h1", "Highlight"), ("x1", "Citation"), ("keep", "Concept")]
    nodes = spark.createDataFrame([(i, k, i, None, None, None, "d1" if i == "p1" else None, "s") for i, k in rows], cols)
    edges = spark.createDataFrame([("d1", "p1", "CONTAINS", None, None), ("h1", "d1", "EXTRACTED_FROM", None, None), ("x1", "p1", "FOR_PAPER", None, None), ("keep", "p1", "USES", None, "s")], "src string, dst string, type string, doc_id string, session_id string")
    left = M.delete_document(PropertyGraph(nodes, edges), "d1")
    assert [r["id"] for r in left.nodes.collect()] == ["keep"] and left.edges.count() == 0
    assert M.delete_session(PropertyGraph(nodes, edges), "s").nodes.count() == 0
    assert M.set_properties(nodes, "d1", title="T").where("id = 'd1'").first()["title"] == "T"


def test_upsert_is_idempotent_and_merges_families(spark):
    cols = "id string, label string, name string, title string, description string, difficulty_level string, doc_id string, session_id string"
    nodes = spark.createDataFrame([("node-1", "Topic", "Graphs", None, "old", None, None, "s")], cols)
    new = spark.createDataFrame([("node-2", "Keyword", " graphs", "T", "new", "s"), ("node-3", "Keyword", "Trees", None, "tall", "s")], "id string, label string, name string, title string, description string, session_id string")
    once = M.upsert_nodes(nodes, new)
    got = {r["id"]: (r["title"], r["description"]) for r in once.collect()}
    assert got == {"node-1": ("T", "old"), "node-3": (None, "tall")}
    assert sorted(map(tuple, M.upsert_nodes(once, new).collect()), key=repr) == sorted(map(tuple, once.collect()), key=repr)
    over = {r["id"]: r["description"] for r in M.upsert_nodes(nodes, new, "overwrite").collect()}
    assert over["node-1"] == "new"


def test_whole_components_and_stitches_equal_brute_force(spark, monkeypatch):
    """All sessions, edge types and id lengths of a fixture count, not a thin part of them."""
    from weftgraph.operators.graph import PropertyGraph
    from weftgraph.plans import graph_queries

    ids = ["r0", "a", "bb", "ccc", "dddd", "e", "ff", "ggg", "h"]
    links = [("r0", "a", "HAS"), ("a", "bb", "AUTHORED_BY"), ("dddd", "ccc", "AUTHORED_BY"), ("ccc", "e", "PREREQUISITE_OF"), ("ggg", "ff", "EXTENDS")]
    nodes = spark.createDataFrame([(x, str(i % 3), "Concept") for i, x in enumerate(ids)], "id string, session_id string, label string")
    edges = spark.createDataFrame([(a, b, t, str(i)) for i, (a, b, t) in enumerate(links)], "src string, dst string, type string, session_id string")
    monkeypatch.setattr(graph_queries, "derived_graph", lambda *_: PropertyGraph(nodes, edges))
    up = {x: x for x in ids}
    for _ in ids:
        for a, b, _t in links:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["id"]: r["component"] for r in graph_queries.QUERIES["components"](spark, "").collect()}
    assert got == up
    stitched = {(r["src"], r["dst"]) for r in graph_queries.QUERIES["component_stitch"](spark, "").collect()}
    assert stitched == {("r0", "ccc"), ("r0", "ff"), ("r0", "h")}

"""Upserts and deletes as functions from one graph to the next; write the result as a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .graph import PropertyGraph

#: Labels that are one family when a node is looked up by name.
CONCEPT_FAMILY = ("Concept", "Topic", "Subtopic", "Technology", "Framework", "Application", "Keyword", "Method", "Dataset")


def stable_id(scope: Column, name: Column) -> Column:
    """An id that a repeated run gives again."""
    return F.sha2(F.concat_ws("|", scope, F.lower(F.trim(name))), 256)


def family(label: Column) -> Column:
    return F.when(label.isin(*CONCEPT_FAMILY), "Concept").otherwise(label)


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[f"new_{k}"])
    return cond


#: What besides name and label family tells nodes apart: their session, nothing, or their document.
MERGE_KEYS = {"session": ["session_id"], "name": [], "document": ["doc_id"]}


def upsert_nodes(nodes: DataFrame, new: DataFrame, on_match: str = "fill", key: str = "session") -> DataFrame:
    """Merge by lower-cased name, label family and, by ``key``, session, document or neither.

    ``fill``: a match keeps its non-empty description and takes title, year and doi where given; ``overwrite``: it takes every given value. Unmatched
    rows are added with their id, or a stable one. Of several new rows with one key the last (``ord``) counts.

    The last new rows are stored, so that Spark knows their size: where they are few the nodes stay where they are, and nodes without a name meet nothing in any case.
    """
    scope = MERGE_KEYS[key]
    keyed = lambda df: df.withColumn("_k", F.lower(F.trim("name"))).withColumn("_f", family(F.col("label")))
    keys, order = ["_k", "_f", *scope], "ord" if "ord" in new.columns else "name"
    rest = [c for c in new.columns if c not in (*scope, "ord")]
    last = keyed(new).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order)).alias("last")).select(*keys, "last.*")
    other = materialise(last.select(*[F.col(c).alias(f"new_{c}") for c in last.columns]), "upserts", light=True)
    old = keyed(nodes)
    matched = old.join(other, _null_safe(old, other, keys) & old["_k"].isNotNull(), "left")
    met = old.where("_k is not null").join(other.select(*[f"new_{k}" for k in keys]), _null_safe(old, other, keys), "left_semi").select(*keys).distinct()
    unmet = other.join(met, _null_safe(met, other, keys), "left_anti")
    added = unmet.select(*[F.lit(None).cast(kind).alias(c) for c, kind in nodes.dtypes], *other.columns)
    joined = matched.select(*nodes.columns, *other.columns).unionByName(added)
    fresh = F.col("id").isNull()
    place = [F.coalesce(f"new_{c}", F.lit("")) for c in scope] or [F.lit("")]
    out = []
    for c in nodes.columns:
        if f"new_{c}" not in other.columns:
            out.append(F.col(c))
        elif c == "id":
            out.append(F.coalesce("id", "new_id", stable_id(place[0], F.col("new_name"))).alias("id"))
        elif c in ("session_id", "doc_id", "name", "label"):
            out.append(F.when(fresh, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c))
        elif on_match == "fill" and c not in ("title", "year", "doi"):
            text = dict(nodes.dtypes)[c] == "string"
            kept = F.when(F.col(c) != "", F.col(c)) if text else F.col(c)
            out.append(F.when(fresh, F.col(f"new_{c}")).otherwise(F.coalesce(kept, f"new_{c}", c)).alias(c))
        else:
            out.append(F.when(fresh, F.col(f"new_{c}")).otherwise(F.coalesce(f"new_{c}", c)).alias(c))
    return joined.select(*out)


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Merge by ends and type; the new row's scope counts."""
    rows = edges.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("src", "dst", "type").orderBy(F.desc("_new"), F.desc("doc_id"), F.desc("session_id"))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_new", "_rn")


def merge_graph(g: PropertyGraph, new: PropertyGraph, key: str = "session") -> PropertyGraph:
    """``new`` upserted into ``g``: nodes by name, family and ``key``, edges between the nodes that theirs have become."""
    nodes = upsert_nodes(g.nodes, new.nodes, key=key)
    keyed = lambda df: df.withColumn("_k", F.lower(F.trim("name"))).withColumn("_f", family(F.col("label")))
    mine = keyed(new.nodes).select("id", "_k", "_f", *MERGE_KEYS[key])
    theirs = keyed(nodes).where("_k is not null").groupBy("_k", "_f", *MERGE_KEYS[key]).agg(F.min("id").alias("_to"))
    theirs = theirs.select("_to", *[F.col(c).alias(f"new_{c}") for c in ("_k", "_f", *MERGE_KEYS[key])])
    became = mine.join(theirs, _null_safe(mine, theirs, ["_k", "_f", *MERGE_KEYS[key]])).select("id", "_to")
    edges = new.edges
    for end in ("src", "dst"):
        edges = edges.join(became.select(F.col("id").alias(end), "_to"), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return PropertyGraph(nodes, upsert_edges(g.edges, edges.select(*g.edges.columns)))


def link_contents(edges: DataFrame, document_id: str, ids: DataFrame) -> DataFrame:
    """A document contains nodes; links that are there already stay single."""
    none = F.lit(None).cast("string")
    new = ids.select(F.lit(document_id).alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("type"), none.alias("doc_id"), none.alias("session_id")).distinct()
    return edges.unionByName(new.join(edges.where("type = 'CONTAINS'").select("src", "dst"), ["src", "dst"], "left_anti").select(*edges.columns))


def drop_nodes(g: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """Without the nodes and every edge that touches them."""
    gone = ids.select("id").distinct()
    edges = g.edges.join(gone, F.col("src") == F.col("id"), "left_anti").join(gone, F.col("dst") == F.col("id"), "left_anti")
    return PropertyGraph(g.nodes.join(gone, "id", "left_anti"), edges)


def document_cascade(g: PropertyGraph, document_id: str) -> DataFrame:
    """Ids that go with a document: itself, its nodes, highlights taken from it and citations of its papers."""
    own = g.nodes.where(F.col("doc_id") == document_id).select("id", "label")
    papers = own.where("label = 'Paper'").select(F.col("id").alias("dst"))
    lights = g.edges.where((F.col("type") == "EXTRACTED_FROM") & (F.col("dst") == document_id)).select(F.col("src").alias("id"))
    cites = g.edges.where("type = 'FOR_PAPER'").join(papers, "dst", "left_semi").select(F.col("src").alias("id"))
    itself = g.nodes.where(F.col("id") == document_id).select("id")
    return own.select("id").unionByName(lights).unionByName(cites).unionByName(itself).distinct()


def delete_document(g: PropertyGraph, document_id: str) -> PropertyGraph:
    return drop_nodes(g, document_cascade(g, document_id))


def delete_session(g: PropertyGraph, session_id: str) -> PropertyGraph:
    return drop_nodes(g, g.nodes.where(F.col("session_id") == session_id))


def delete_failed_run(g: PropertyGraph, document_id: str) -> PropertyGraph:
    """Nodes and edges that a failed run has left; the document itself stays to show its error."""
    left = PropertyGraph(g.nodes, g.edges.where(~F.coalesce(F.col("doc_id") == document_id, F.lit(False))))
    return drop_nodes(left, g.nodes.where((F.col("doc_id") == document_id) & (F.col("label") != "Document")))


def keep_single_document(g: PropertyGraph, document_id: str) -> PropertyGraph:
    """Everything but the document goes."""
    return PropertyGraph(g.nodes.where(F.col("id") == document_id), g.edges.where("false"))


def set_properties(nodes: DataFrame, node_id: str, **values) -> DataFrame:
    own = F.col("id") == node_id
    return nodes.select(*[F.when(own, F.lit(values[c]).cast(t)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c, t in nodes.dtypes])


def append_graph(g: PropertyGraph, nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
    """New nodes replace old ones of the same id, old edges stay before new ones of the same ends and type."""
    kept = g.nodes.join(nodes.select("id"), "id", "left_anti")
    fresh = edges.join(g.edges.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti").dropDuplicates(["src", "dst", "type"])
    return PropertyGraph(kept.unionByName(nodes.dropDuplicates(["id"]), allowMissingColumns=True), g.edges.unionByName(fresh, allowMissingColumns=True))


def last_value_first_place(rows: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """One row for each key: the place of its first and the value of its last row."""
    return rows.groupBy(key).agg(F.min(pos).alias(pos), F.max_by(value, pos).alias(value))


def merge_settings(old: Column, new: Column) -> Column:
    """Maps merged, new entries first."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)

"""A document uploaded, read, ingested and written into a graph, as one operation with its states."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mutations
from ..operators.graph import PropertyGraph
from ..schema import EDGES, NODES, UTILITY_LABELS
from ..sources.blobs import BlobStore, pdf_pages
from ..sources.versions import Conflict, GraphStore
from ..storage import materialise
from . import ingest as plan

BUCKET = "documents"


@dataclass(frozen=True)
class Uploaded:
    """The graph after an upload, the new document's id and its states ``doc_id, seq, status, progress_pct, error``."""

    graph: PropertyGraph
    doc_id: str
    events: DataFrame


def empty_graph(spark: SparkSession) -> PropertyGraph:
    return PropertyGraph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))


def remove_document(store: BlobStore, g: PropertyGraph, document_id: str, session_id: str | None = None) -> PropertyGraph:
    """The graph without a document and all that hangs on it; its blob goes too. ``KeyError`` if it is nowhere, ``PermissionError`` if it is another session's."""
    row = g.nodes.where((F.col("label") == "Document") & (F.col("id") == document_id)).select("title", "session_id").first()
    if row is None:
        raise KeyError("Document not found.")
    if session_id is not None and row["session_id"] != session_id:
        raise PermissionError("Access denied. Document does not belong to this session.")
    store.delete(BUCKET, f"{document_id}_{row['title']}")
    return mutations.delete_document(g, document_id)


def remove_session(store: BlobStore, g: PropertyGraph, session_id: str) -> PropertyGraph:
    """The graph without a session; the blobs of its documents go too."""
    for row in g.nodes.where((F.col("label") == "Document") & (F.col("session_id") == session_id)).select("id", "title").toLocalIterator():
        store.delete(BUCKET, f"{row['id']}_{row['title']}")
    return mutations.delete_session(g, session_id)


def upload(
    store: BlobStore,
    g: PropertyGraph,
    filename: str,
    data: bytes,
    session_id: str | None = None,
    replace_doc_id: str | None = None,
    multi: bool = False,
    suffix: str = ".pdf",
    reader: Callable[[DataFrame], DataFrame] = pdf_pages,
    doc_id: str | None = None,
    **params,
) -> Uploaded:
    """Store a document and ingest it into ``g``; ``params`` go to ``ingest``.

    Other suffixes are refused (``ValueError``). A document to be replaced goes first. Outside sessions, and unless ``multi``, a new document
    is the only one: graph and bucket are emptied. A run that fails leaves the document with its error and nothing else.
    """
    if not filename.endswith(suffix):
        raise ValueError(f"Only {suffix.strip('.').upper()} documents are supported.")
    if replace_doc_id is not None:
        g = remove_document(store, g, replace_doc_id, session_id)
    if session_id is None and not multi:
        store.clear(BUCKET)
        g = empty_graph(store.spark)
    doc_id = doc_id or str(uuid.uuid4())
    rows, url = _stored(store, doc_id, filename, data, reader)
    graph, events = _ingested(g, doc_id, filename, url, rows, session_id, multi, params)
    return Uploaded(graph, doc_id, events)


def _stored(store: BlobStore, doc_id: str, filename: str, data: bytes, reader: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, str]:
    """(pages ``doc_id, page_no, text``, not read yet, and the blob's url)."""
    name = f"{doc_id}_{filename}"
    url = store.upload(BUCKET, name, data)
    return reader(store.read(BUCKET, name)).select(F.lit(doc_id).alias("doc_id"), "page_no", "text"), url


def _ingested(g: PropertyGraph, doc_id: str, filename: str, url: str, rows: DataFrame, session_id: str | None, multi: bool, params: dict) -> tuple[PropertyGraph, DataFrame]:
    """(``g`` with a document's knowledge or its error, the run's events)."""
    spark = g.nodes.sparkSession
    files = spark.createDataFrame([(doc_id, filename)], "doc_id string, filename string")
    state = {"status": "processing", "progress_pct": 10, "error_msg": None}
    try:
        rows = materialise(rows, "pages")
        if rows.isEmpty():  # nothing could be read: a run without text
            rows = spark.createDataFrame([(doc_id, 0, "")], "doc_id string, page_no int, text string")
        new, status = plan.ingest(rows, session_id, known=g.nodes, files=files, **params)
        done = status.first()
        state |= {"status": done["status"], "progress_pct": 100, "error_msg": done["error"]}
    except Exception as e:  # noqa: BLE001  the run's error is the document's state
        new, status = None, spark.createDataFrame([(doc_id, "error", str(e))], "doc_id string, status string, error string")
        state |= {"status": "error", "progress_pct": 100, "error_msg": str(e)}
    if new is not None and state["status"] == "done":
        # what the graph has already keeps its description and its document
        fresh = PropertyGraph(new.nodes.where("label != 'Document'"), new.edges)
        g = mutations.merge_graph(g, fresh, key="session" if session_id is not None else "name" if multi else "document")
    g = mutations.delete_failed_run(g, doc_id) if state["status"] == "error" else g
    document = spark.createDataFrame(
        [(doc_id, "Document", filename, session_id, url, state["status"], state["progress_pct"], state["error_msg"])],
        "id string, label string, title string, session_id string, storage_url string, status string, progress_pct int, error_msg string",
    ).withColumn("upload_date", F.current_timestamp())
    graph = PropertyGraph(g.nodes.unionByName(document, allowMissingColumns=True), g.edges)
    clean = rows.select("doc_id").distinct()
    pieces = plan.chunk_rows(plan.clean_documents(rows)) if state["status"] == "done" else spark.createDataFrame([], "doc_id string, chunk_no int, chunk string")
    return graph, plan.status_events(clean if state["status"] == "done" else clean.where("false"), pieces, status)


@dataclass(frozen=True)
class Written:
    """The version of the stored graph that an upload has made, the new document's id and its states."""

    version: int
    doc_id: str
    events: DataFrame


def session_buckets(graphs: GraphStore, session_id: str, *more: str, version: int | None = None) -> set[int]:
    """Buckets with a session's rows: its own, and those of its documents, notes, highlights and citations, whose links may carry no session."""
    sources = graphs.session(session_id, version).nodes.where(F.col("label").isin(*UTILITY_LABELS)).select("id")
    return graphs.buckets_of([session_id, *more]) | graphs.buckets_of(sources)


def _own_document(graphs: GraphStore, document_id: str, session_id: str) -> str:
    """The blob's name of a session's document; the errors of ``remove_document``. The whole graph is looked at only if the session does not have it."""
    is_it = (F.col("label") == "Document") & (F.col("id") == document_id)
    row = graphs.session(session_id).nodes.where(is_it).select("title").first()
    if row is None:
        if graphs.read().nodes.where(is_it).isEmpty():
            raise KeyError("Document not found.")
        raise PermissionError("Access denied. Document does not belong to this session.")
    return f"{document_id}_{row['title']}"


def _committed(graphs: GraphStore, session_id: str, document_id: str | None, change: Callable[[PropertyGraph], PropertyGraph], tries: int) -> int:
    """The version after ``change`` of a session's buckets, told anew and tried again when another writer was there first."""
    while True:
        now = graphs.versions()[-1]
        own = session_buckets(graphs, session_id, *([document_id] if document_id else []), version=now)
        try:
            return graphs.update(own, change, since=now)
        except Conflict:
            tries -= 1
            if tries <= 0:
                raise


def upload_into(
    store: BlobStore,
    graphs: GraphStore,
    filename: str,
    data: bytes,
    session_id: str,
    replace_doc_id: str | None = None,
    suffix: str = ".pdf",
    reader: Callable[[DataFrame], DataFrame] = pdf_pages,
    doc_id: str | None = None,
    tries: int = 5,
    **params,
) -> Written:
    """``upload`` of a session's document into a stored graph: only the session's buckets are read and written, and uploads at once lose none of one another's rows.

    Uploads into other buckets are put in order. One that has met another in its own is merged again, with what the other has added known to it, up to ``tries`` times (then
    ``Conflict``). The blob of a replaced document goes after the new version is there, so a failure on the way leaves a graph whose blobs all exist.
    """
    if not filename.endswith(suffix):
        raise ValueError(f"Only {suffix.strip('.').upper()} documents are supported.")
    old = None if replace_doc_id is None else _own_document(graphs, replace_doc_id, session_id)
    doc_id = doc_id or str(uuid.uuid4())
    rows, url = _stored(store, doc_id, filename, data, reader)
    events: list[DataFrame] = []

    def change(part: PropertyGraph) -> PropertyGraph:
        g = part if replace_doc_id is None else mutations.delete_document(part, replace_doc_id)
        g, told = _ingested(g, doc_id, filename, url, rows, session_id, True, params)
        events[:] = [told]
        return g

    version = _committed(graphs, session_id, doc_id, change, tries)
    if old is not None and old != f"{doc_id}_{filename}":
        store.delete(BUCKET, old)
    return Written(version, doc_id, events[0])


def remove_document_from(store: BlobStore, graphs: GraphStore, document_id: str, session_id: str, tries: int = 5) -> int:
    """``remove_document`` of a session in a stored graph; returns the version without it. The blob goes last."""
    name = _own_document(graphs, document_id, session_id)
    version = _committed(graphs, session_id, document_id, lambda part: mutations.delete_document(part, document_id), tries)
    store.delete(BUCKET, name)
    return version


def remove_session_from(store: BlobStore, graphs: GraphStore, session_id: str, tries: int = 5) -> int:
    """``remove_session`` in a stored graph; returns the version without it. The blobs of its documents go last."""
    gone: list[DataFrame] = []

    def change(part: PropertyGraph) -> PropertyGraph:
        own = (F.col("label") == "Document") & (F.col("session_id") == session_id)
        gone[:] = [part.nodes.where(own).select(F.concat_ws("_", "id", "title").alias("name"))]
        return mutations.delete_session(part, session_id)

    version = _committed(graphs, session_id, None, change, tries)
    for row in gone[0].toLocalIterator():
        store.delete(BUCKET, row["name"])
    return version

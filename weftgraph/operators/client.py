"""What a client does with a graph: validation, label groups, lookups, session lists, service state, prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EXTRACTION_LABELS
from ..storage import materialise
from .graph import PropertyGraph

#: Labels shown together under one name.
LABEL_GROUPS = {"Concept": ("Concept", "Keyword", "Method", "Dataset", "Subtopic"), "Paper": ("Paper", "Author")}


def valid_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with an id and a label, names and levels filled in, coordinates that are no number made null; edges between them, typed."""
    filled = lambda c, default: F.coalesce(F.when(F.trim(c) != "", F.col(c)), F.lit(default)).alias(c)
    fixed = {"name": filled("name", "Unknown Node"), "description": F.coalesce("description", F.lit("")).alias("description"), "difficulty_level": filled("difficulty_level", "Beginner")}
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    good = nodes.where((F.trim("id") != "") & (F.trim("label") != "")).select(*[fixed.get(c) if c in fixed else number(c) if t in ("double", "float") else F.col(c) for c, t in nodes.dtypes])
    typed = edges.select(*[filled("type", "RELATED_TO") if c == "type" else F.col(c) for c in edges.columns])
    return good, PropertyGraph(good, typed).induced().edges


def label_group(nodes: DataFrame, group: str, path: list[str] | None = None) -> DataFrame:
    """Nodes of a group of labels, of one label, or on a given path (``Learning Path``)."""
    if group == "Learning Path":
        return nodes.where(F.col("id").isin(*(path or [])) if path else F.lit(False))
    return nodes.where(F.col("label").isin(*LABEL_GROUPS.get(group, (group,))))


def path_nodes(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pos`` and the nodes of ``path``, in order; ids without a node drop out."""
    return paths.select(F.posexplode("path").alias("pos", "id")).join(nodes, "id")


def selectable(texts: DataFrame, column: str = "text", least: int = 5) -> DataFrame:
    """Selections of more than ``least`` characters."""
    return texts.where(F.length(F.trim(column)) > least)


def around(g: PropertyGraph, target: str, mode: str = "basic") -> DataFrame:
    """Edges of one hop in either direction: prerequisites only, or all but documents' own links."""
    kind = F.col("type") == "PREREQUISITE_OF" if mode == "basic" else F.col("type") != "CONTAINS"
    return g.edges.where(((F.col("src") == target) | (F.col("dst") == target)) & kind).select("src", "dst", "type").distinct()


def newest_sessions(sessions: DataFrame) -> DataFrame:
    """``id, name, created_at, ord``: the first of each id, newest first."""
    first = sessions.withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy("ord"))).where("_rn = 1")
    return first.drop("_rn").orderBy(F.desc("created_at"), "id")


def delete_session_entry(sessions: DataFrame, session_id: str, current: str) -> tuple[DataFrame, str]:
    """(list, current session): the last session stays; if the current one goes, the newest left takes its place."""
    left = sessions.where(F.col("id") != session_id)
    newest = left.orderBy(F.desc("created_at"), "id").select("id").first()
    if newest is None:
        return sessions, current
    return left, newest["id"] if current == session_id else current


def create_session_entry(sessions: DataFrame, session_id: str, name: str | None, created_at: int) -> DataFrame:
    """The list with a new session (``Untitled Session`` without a name), of each id the first, newest first."""
    new = sessions.sparkSession.createDataFrame([(session_id, name or "Untitled Session", created_at)], "id string, name string, created_at long")
    last = sessions.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("m")).first()["m"]
    return newest_sessions(sessions.unionByName(new.withColumn("ord", F.lit(last + 1).cast(sessions.schema["ord"].dataType))))


def name_sessions(sessions: DataFrame, documents: DataFrame) -> DataFrame:
    """Sessions named after their first document (``session_id, title, ord``); one without documents keeps its name."""
    first = documents.groupBy(F.col("session_id").alias("id")).agg(F.min_by("title", "ord").alias("_title"))
    return sessions.join(first, "id", "left").withColumn("name", F.coalesce("_title", "name")).select(*sessions.columns)


def set_status(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """List rows with the ``status`` and ``progress_pct`` of ``changes`` of the same id."""
    new = changes.select("id", F.col("status").alias("_s"), F.col("progress_pct").alias("_p"))
    out = rows.join(new, "id", "left").withColumn("status", F.coalesce("_s", "status")).withColumn("progress_pct", F.coalesce("_p", "progress_pct"))
    return out.select(*rows.columns)


def remove(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """List rows without those ids."""
    return rows.join(ids.select("id").distinct(), "id", "left_anti").select(*rows.columns)


def retry_schedule(attempts: int = 3, delay_ms: int = 1000, every_ms: int = 15_000) -> list[int]:
    """Milliseconds of wait after each failed health check: a linear back-off, then the regular interval."""
    return [delay_ms * k for k in range(1, attempts)] + [every_ms]


def check_waits(checks: DataFrame, attempts: int = 3, delay_ms: int = 1000, every_ms: int = 15_000) -> DataFrame:
    """``check_id, service, state, wait_ms`` of health checks ``check_id, service, at, ok``: what is shown after each, and how long until the next.

    The first ``attempts`` of a service, while none has gone well, follow ``retry_schedule`` and show no error (``retrying``) but after the last; a check that goes well, and every one
    after the first load, is followed by the regular interval. Checks of one time come in order of ``check_id``; a check without an answer (null) has failed. Only the first few of
    a service are put in order.
    """
    rows = checks.select("check_id", "service", "at", F.coalesce("ok", F.lit(False)).alias("ok"))
    place = Window.partitionBy("service").orderBy("at", "check_id")
    first = rows.withColumn("n", F.row_number().over(place)).where(F.col("n") <= attempts)
    before = F.coalesce(F.max("ok").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    waits = F.array(*map(F.lit, retry_schedule(attempts, delay_ms, every_ms)))
    retried = first.withColumn("before", before).where(~F.col("ok") & ~F.col("before") & (F.col("n") < attempts)).select("check_id", F.element_at(waits, F.col("n")).alias("retry"))
    state = F.when(F.col("ok"), "ok").when(F.col("retry").isNotNull(), "retrying").otherwise("error")
    return rows.join(retried, "check_id", "left").select("check_id", "service", state.alias("state"), F.coalesce("retry", F.lit(every_ms)).cast("long").alias("wait_ms"))


def in_order(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with their place ``pos``, from 0, in order of ``by``: sorted in ranges, each of which begins after the rows of those before it. No task sees all rows."""
    placed = materialise(rows.sort(by).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftrightunsigned("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # as many rows as there are ranges
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*rows.columns, place.cast("long").alias("pos"))


def prepend(rows: DataFrame, new: DataFrame, pos: str = "pos") -> DataFrame:
    """New rows before the old ones; positions count on."""
    n = new.agg(F.count("*").alias("n")).withColumn("one", F.lit(1))  # a single row
    moved = rows.withColumn("one", F.lit(1)).join(F.broadcast(n), "one").withColumn(pos, F.col(pos) + F.col("n")).drop("one", "n")
    return new.unionByName(moved.select(*new.columns))


def services_ok(checks: DataFrame) -> DataFrame:
    """``status, failing``: ``ok`` when every service is, else ``degraded``."""
    bad = F.col("status") != "ok"
    return checks.agg(F.when(F.coalesce(F.bool_or(bad), F.lit(False)), "degraded").otherwise("ok").alias("status"), F.count_if(bad).alias("failing"))


def prompt_context(node: Column, prerequisites: Column, related: Column, papers: Column) -> Column:
    """What a language model is told about a node (``name, description, difficulty_level``; null when nothing is selected); empty lists are left out."""
    # The keys of the context.
    listed = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", "), F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("Focus Node: "), node["name"], F.lit("\nDescription: "), node["description"], F.lit("\nDifficulty: "), node["difficulty_level"], F.lit("\n"))
    told = F.concat(head, listed("Prerequisites: ", prerequisites), listed("Related concepts: ", related), listed("Grounding Papers: ", papers))
    return F.when(node.isNotNull(), told).otherwise("No focus node currently selected.")


def isolated_extraction(chunks: DataFrame, extract: Callable[[str], dict], attempts: int = 2) -> DataFrame:
    """``doc_id, chunk_no, nodes, relationships, error`` by a function of one chunk: tried again once, then the chunk is skipped with its error."""
    kind = chunks.schema["doc_id"].dataType.simpleString()
    labels = list(EXTRACTION_LABELS)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for doc, no, text in zip(pdf["doc_id"], pdf["chunk_no"], pdf["chunk"], strict=True):
                got, error = None, None
                for _ in range(attempts):
                    try:
                        got, error = extract(text), None
                        break
                    except Exception as e:  # noqa: BLE001  one chunk must not fail the others
                        error = f"{type(e).__name__}: {e}"
                nodes = [{"label": n.get("label") if n.get("label") in labels else "Concept", "name": n.get("name"), "description": n.get("description")} for n in (got or {}).get("nodes", [])]
                rels = [{"from": r.get("from"), "to": r.get("to"), "type": r.get("type")} for r in (got or {}).get("relationships", [])]
                rows.append((doc, no, nodes, rels, error))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "nodes", "relationships", "error"])

    schema = f"doc_id {kind}, chunk_no int, nodes array<struct<label:string,name:string,description:string>>, relationships array<struct<`from`:string,`to`:string,type:string>>, error string"
    return chunks.select("doc_id", "chunk_no", "chunk").mapInPandas(run, schema)


def extractor(extract: Callable[[str], dict], attempts: int = 2):
    """An extractor for ``ingest`` from a function of one chunk: a chunk that fails twice is skipped and the others go on."""
    def run(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
        got = materialise(isolated_extraction(pieces, extract, attempts), "extracted")
        nodes = got.select("doc_id", "chunk_no", F.posexplode("nodes").alias("ord", "n")).select("doc_id", "chunk_no", "ord", "n.*")
        rels = got.select("doc_id", "chunk_no", F.explode("relationships").alias("r"))
        return nodes, rels.select("doc_id", "chunk_no", F.col("r.from").alias("from_name"), F.col("r.to").alias("to_name"), F.col("r.type").alias("type"))

    return run

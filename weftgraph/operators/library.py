"""Notes, highlights, citations and chat answers on top of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import citation
from ..schema import blank_to_null
from . import automaton
from .graph import PropertyGraph
from .mutations import CONCEPT_FAMILY, stable_id

# Stems that earn a provisional concept when no concept of the session covers them, tried in order, and the concept's name.
NOTE_TRIGGERS = (("neural", "Neural Networks"), ("transformer", "Transformers"))
HIGHLIGHT_TRIGGERS = (("attention", "Self-attention"), ("gradient", "Gradient Descent"))
PROVISIONAL = "Provisional concept created from {}."


#: Up to so many bytes of distinct names, a state each at most, one automaton is broadcast (a row of some forty 4-byte entries a state).
AUTOMATON_BYTES = 200_000


def concept_mentions(texts: DataFrame, names: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """``text_id, name`` where a text contains a name, regardless of case and word bounds.

    ``texts(text_id, text)``, ``names(name)``, both with the columns ``scope`` if names count within a scope only. The names' bytes are counted first: up to
    ``AUTOMATON_BYTES`` one automaton finds them all in a single pass over the texts, which are not shuffled; beyond it names and texts meet in joins (``_by_rarest_gram``).
    """
    scope = scope or []
    name = F.lower(F.trim("name"))
    keyed = names.where(F.length(name) > 0).select(*scope, "name", name.alias("low_name")).distinct()
    bodies = texts.select("text_id", *scope, F.lower("text").alias("low")).where("low is not null")
    distinct = keyed.select("low_name").distinct()
    size = distinct.agg(F.coalesce(F.sum(F.octet_length("low_name")), F.lit(0)).alias("n")).first()["n"]
    if size > AUTOMATON_BYTES:
        return _by_rarest_gram(bodies, keyed, scope)
    strings = [r["low_name"] for r in distinct.collect()]  # counted above
    found = automaton.occurrences(bodies, sorted(strings))
    return found.join(keyed, [*scope, "low_name"]).select("text_id", "name").distinct()


def _by_rarest_gram(bodies: DataFrame, keyed: DataFrame, scope: list[str]) -> DataFrame:
    """The same for any number of names: each name is looked for in the texts that have its rarest string of three letters (or the whole name if it is shorter).

    Strings are counted over all texts, so a name that begins like many others does not meet every text; only ids and strings meet, and a text is fetched once for
    all of its candidates, which are then verified.
    """

    def grams(text: Column, k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - k + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))

    whole = F.length("low_name")
    own = F.when(whole < 3, F.array("low_name")).otherwise(F.array_distinct(grams(F.col("low_name"), 3)))
    offered = keyed.select(*scope, "name", "low_name", F.explode(own).alias("gram"))
    used = offered.select("gram").distinct()
    every = F.array_distinct(F.concat(*[grams(F.col("low"), k) for k in (1, 2, 3)]))
    # outer: a plain explode would make the optimiser compute the arrays once more to filter empty ones, of which there are none
    rows = bodies.select("text_id", *scope, F.explode_outer(every).alias("gram")).join(used, "gram", "left_semi")
    often = rows.groupBy(*scope, "gram").agg(F.count("*").alias("texts"))
    # a name with a string that no text has cannot occur
    rated = offered.join(often, [*scope, "gram"], "left").groupBy(*scope, "name", "low_name").agg(F.min_by("gram", F.struct(F.coalesce("texts", F.lit(0)), "gram")).alias("gram"))
    likely = rows.join(rated, [*scope, "gram"]).select("text_id", *scope, "name", "low_name").distinct()
    return bodies.join(likely, ["text_id", *scope]).where(F.contains("low", F.col("low_name"))).select("text_id", "name").distinct()


def provisional_concepts(texts: DataFrame, concepts: DataFrame, triggers: tuple[tuple[str, str], ...]) -> DataFrame:
    """``text_id, session_id, name``: for each text the first of the triggers in it that no concept of its session covers.

    ``texts(text_id, text, session_id)``, ``concepts(name, session_id)``.
    """
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("trigger"), F.lit(n).alias("name")) for i, (t, n) in enumerate(triggers)]))
    rows = texts.select("text_id", "session_id", F.lower("text").alias("low"), asked.alias("t")).where(F.contains("low", F.col("t.trigger"))).select("text_id", "session_id", "t.*")
    covers = [F.when(F.contains(F.lower("name"), F.lit(t)), F.lit(t)) for t, _ in triggers]
    covered = concepts.select("session_id", F.explode(F.array_compact(F.array(*covers))).alias("trigger")).distinct()
    free = rows.join(covered, rows["session_id"].eqNullSafe(covered["session_id"]) & (rows["trigger"] == covered["trigger"]), "left_anti")
    return free.groupBy("text_id", "session_id").agg(F.min_by("name", "i").alias("name"))


def _rows(df: DataFrame, **values) -> DataFrame:
    return df.select(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()])


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _named(g: PropertyGraph, texts: DataFrame, triggers) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(concepts ``id, name, session_id``; ``text_id, session_id, name`` of those that ``texts`` mention; the same of provisional ones): a name once for each text, however many nodes bear it."""
    known = g.nodes.where(F.col("label").isin(*CONCEPT_FAMILY)).select("id", "name", "session_id")
    said = concept_mentions(texts, known.select("name", "session_id").distinct(), ["session_id"]).join(texts.select("text_id", "session_id"), "text_id")
    return known, said, provisional_concepts(texts, known, triggers)


def _names(g: PropertyGraph, texts: DataFrame, triggers) -> DataFrame:
    _, said, new = _named(g, texts, triggers)
    return said.select(F.col("text_id").alias("src"), "name", F.lit(False).alias("fresh")).unionByName(new.select(F.col("text_id").alias("src"), "name", F.lit(True).alias("fresh"))).distinct()


def _add_texts(g: PropertyGraph, texts: DataFrame, fresh: DataFrame, relation: str, triggers, kind: str) -> PropertyGraph:
    """New notes or highlights (``fresh``) linked with the concepts of their session that ``texts`` mention, or with a provisional one."""
    known, said, new = _named(g, texts, triggers)
    links = said.join(known.withColumnRenamed("id", "dst"), ["name", "session_id"]).select(F.col("text_id").alias("src"), "dst")
    made = new.select("session_id", "name").distinct().withColumn("id", stable_id(F.coalesce("session_id", F.lit("")), F.col("name")))
    born = _rows(made, id=F.col("id"), label="Concept", name=F.col("name"), description=PROVISIONAL.format(kind), difficulty_level="Beginner", session_id=F.col("session_id"), provisional=True)
    links = links.unionByName(new.select(F.col("text_id").alias("src"), stable_id(F.coalesce("session_id", F.lit("")), F.col("name")).alias("dst")))
    edges = _rows(links.distinct(), src=F.col("src"), dst=F.col("dst"), type=relation, doc_id=_none(), session_id=_none())
    nodes = g.nodes.unionByName(fresh, allowMissingColumns=True).unionByName(born, allowMissingColumns=True)
    return PropertyGraph(nodes, g.edges.unionByName(edges))


def create_notes(g: PropertyGraph, notes: DataFrame) -> PropertyGraph:
    """The graph with ``notes(id, content, session_id, created_at)``, each linked (``REFERENCES``) with the concepts of its session that it names."""
    fresh = notes.select("id", F.lit("Note").alias("label"), "content", "created_at", "session_id")
    return _add_texts(g, _note_texts(notes), fresh, "REFERENCES", NOTE_TRIGGERS, "note")


def _note_texts(notes: DataFrame) -> DataFrame:
    return notes.select(F.col("id").alias("text_id"), F.col("content").alias("text"), "session_id")


def note_names(g: PropertyGraph, notes: DataFrame) -> DataFrame:
    """``src, name, fresh`` of the links that ``create_notes`` makes: one row for a note and a name, where the graph has one for each of the session's nodes of that name; ``fresh``: provisional."""
    return _names(g, _note_texts(notes), NOTE_TRIGGERS)


def _own_document(g: PropertyGraph, highlights: DataFrame) -> DataFrame:
    docs = g.nodes.where("label = 'Document'").select(F.col("id").alias("source_document_id"), F.col("session_id").alias("_own")).distinct()
    return highlights.join(docs, "source_document_id", "left").withColumn("status", F.when(F.col("_own") == F.col("session_id"), "OK").otherwise("FORBIDDEN"))


def highlight_names(g: PropertyGraph, highlights: DataFrame) -> DataFrame:
    """``note_names`` of the links that ``create_highlights`` makes."""
    good = _own_document(g, highlights).where("status = 'OK'")
    return _names(g, good.select(F.col("id").alias("text_id"), "text", "session_id"), HIGHLIGHT_TRIGGERS)


def create_highlights(g: PropertyGraph, highlights: DataFrame) -> tuple[PropertyGraph, DataFrame]:
    """(graph, ``id, status``) with ``highlights(id, text, page, source_document_id, session_id, created_at)``.

    A highlight of a document that is not in its session is FORBIDDEN and leaves nothing; the others are ``EXTRACTED_FROM`` their document and ``RELATES_TO`` concepts.
    """
    seen = _own_document(g, highlights)
    good = seen.where("status = 'OK'")
    fresh = good.select("id", F.lit("Highlight").alias("label"), "text", "page", "created_at", "session_id")
    out = _add_texts(g, good.select(F.col("id").alias("text_id"), "text", "session_id"), fresh, "RELATES_TO", HIGHLIGHT_TRIGGERS, "highlight")
    taken = _rows(good, src=F.col("id"), dst=F.col("source_document_id"), type="EXTRACTED_FROM", doc_id=_none(), session_id=_none())
    return PropertyGraph(out.nodes, out.edges.unionByName(taken)), seen.select("id", "status")


def create_citations(g: PropertyGraph, asked: DataFrame) -> tuple[PropertyGraph, DataFrame]:
    """(graph, ``id, status, style, formatted_text, paper_title``) with citations ``asked(id, paper_id, style, session_id)``.

    A paper of another session is FORBIDDEN, one that is nowhere NOT_FOUND; neither leaves a citation.
    """
    extra = {c: F.col(c) if c in g.nodes.columns else _none(t) for c, t in (("year", "int"), ("doi", "string"))}
    papers = g.nodes.where("label = 'Paper'").select(
        F.col("id").alias("paper_id"), F.col("session_id").alias("_own"), F.coalesce(blank_to_null(F.col("title")), blank_to_null(F.col("name")), F.lit("Untitled Paper")).alias("paper_title"),
        *[c.alias(k) for k, c in extra.items()],
    )
    wrote = g.edges.where("type = 'AUTHORED_BY'").select(F.col("src").alias("paper_id"), "dst").join(g.nodes.where("label = 'Author'").select(F.col("id").alias("dst"), "name"), "dst")
    authors = wrote.groupBy("paper_id").agg(F.array_sort(F.collect_set("name")).alias("authors"))
    seen = asked.join(papers, "paper_id", "left").join(authors, "paper_id", "left")
    status = F.when(F.col("paper_title").isNull(), "NOT_FOUND").when(F.col("_own") == F.col("session_id"), "OK").otherwise("FORBIDDEN")
    text = citation(F.col("style"), F.coalesce("authors", F.array().cast("array<string>")), F.col("year"), F.col("paper_title"), F.col("doi"))
    done = seen.withColumn("status", status).withColumn("formatted_text", F.when(F.col("status") == "OK", text))
    good = done.where("status = 'OK'")
    fresh = good.select("id", F.lit("Citation").alias("label"), "style", "formatted_text", "session_id")
    links = _rows(good, src=F.col("id"), dst=F.col("paper_id"), type="FOR_PAPER", doc_id=_none(), session_id=_none())
    out = PropertyGraph(g.nodes.unionByName(fresh, allowMissingColumns=True), g.edges.unionByName(links))
    title = F.when(F.col("status") == "OK", F.col("paper_title"))
    return out, done.select("id", "status", "style", "formatted_text", title.alias("paper_title"))


def citations_of(g: PropertyGraph, session_id: str, style: str | None = None) -> DataFrame:
    """``id, style, formatted_text, paper_title`` of a session's citations, of one style (regardless of case) or all."""
    own = g.nodes.where((F.col("label") == "Citation") & (F.col("session_id") == session_id)).select("id", "style", "formatted_text")
    link = g.edges.where("type = 'FOR_PAPER'").select(F.col("src").alias("id"), F.col("dst").alias("paper"))
    papers = g.nodes.where("label = 'Paper'").select(F.col("id").alias("paper"), F.coalesce("title", "name").alias("paper_title"))
    return citations_by_style(own, style).join(link, "id").join(papers, "paper").drop("paper")


def notes_of(g: PropertyGraph, session_id: str) -> DataFrame:
    """``id, content, created_at, concepts`` of a session's notes, names sorted."""
    own = g.nodes.where((F.col("label") == "Note") & (F.col("session_id") == session_id)).select("id", "content", "created_at")
    link = g.edges.where("type = 'REFERENCES'").select(F.col("src").alias("text_id"), "dst").join(g.nodes.select(F.col("id").alias("dst"), "name"), "dst")
    return notes_with_concepts(own.withColumnRenamed("id", "text_id"), link.select("text_id", "name")).withColumnRenamed("text_id", "id")


def search_notes(notes: DataFrame, needle: str, case_sensitive: bool = False) -> DataFrame:
    """Notes (``content, concepts``) that contain a string themselves or in the name of a concept."""
    fold = (lambda c: c) if case_sensitive else F.lower
    q = needle if case_sensitive else needle.lower()
    return notes.where(F.contains(fold(F.col("content")), F.lit(q)) | F.exists("concepts", lambda c: F.contains(fold(c), F.lit(q))))


def session_view(g: PropertyGraph, session_id: str) -> dict[str, DataFrame]:
    """All that a client loads for a session: ``documents, nodes, edges, notes, highlights, citations``."""
    shown = g.session_subgraph(session_id)
    lights = g.nodes.where((F.col("label") == "Highlight") & (F.col("session_id") == session_id)).select("id", "text", "page", "created_at")
    return {
        "documents": g.documents(session_id), "nodes": shown.nodes, "edges": shown.edges, "notes": notes_of(g, session_id),
        "highlights": highlights_of(g, lights), "citations": citations_of(g, session_id),
    }


def notes_with_concepts(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Notes with their concept names, sorted; a note without any has an empty list. ``links(text_id, name)``."""
    got = links.groupBy("text_id").agg(F.array_sort(F.collect_set("name")).alias("concepts"))
    return notes.join(got, "text_id", "left").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))


def search(rows: DataFrame, column: str, needle: str, case_sensitive: bool = False) -> DataFrame:
    c = F.col(column)
    return rows.where(F.contains(c, F.lit(needle)) if case_sensitive else F.contains(F.lower(c), F.lit(needle.lower())))


def highlights_of(g: PropertyGraph, highlights: DataFrame, concept_id: str | None = None) -> DataFrame:
    """Highlights with the title of their document (``Unknown PDF`` without one), all or those of a concept."""
    if concept_id is not None:
        own = g.edges.where((F.col("type") == "RELATES_TO") & (F.col("dst") == concept_id)).select(F.col("src").alias("id"))
        highlights = highlights.join(own, "id", "left_semi")
    source = g.edges.where("type = 'EXTRACTED_FROM'").select(F.col("src").alias("id"), F.col("dst").alias("doc"))
    docs = g.nodes.where("label = 'Document'").select(F.col("id").alias("doc"), "title")
    return highlights.join(source, "id", "left").join(docs, "doc", "left").select(*highlights.columns, F.coalesce("title", F.lit("Unknown PDF")).alias("document_title"))


def paper_citations(papers: DataFrame, authorship: DataFrame, styles: tuple[str, ...] = ("APA", "MLA", "IEEE")) -> DataFrame:
    """``paper_id, style, formatted_text``. ``papers(paper_id, title, year, doi)``, ``authorship(paper_id, author)``; authors by name."""
    names = authorship.groupBy("paper_id").agg(F.array_sort(F.collect_set(F.trim("author"))).alias("authors"))
    rows = papers.join(names, "paper_id", "left").select("*", F.explode(F.array(*map(F.lit, styles))).alias("style"))
    return rows.select("paper_id", "style", citation(F.col("style"), F.filter("authors", lambda a: a != ""), F.col("year"), F.col("title"), F.col("doi")).alias("formatted_text"))


def citations_by_style(citations: DataFrame, style: str | None = None) -> DataFrame:
    return citations if style is None else citations.where(F.upper("style") == style.upper())


def last_messages(messages: DataFrame, keep: int = 10) -> DataFrame:
    """The last ``keep`` turns of each conversation."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text"))
    return messages.withColumn("_rn", rank).where(F.col("_rn") <= keep).drop("_rn")


def answer(message: Column, node: Column, prerequisites: Column, related: Column, papers: Column, assistant: str = "AI") -> Column:
    """Plain answer to a message about a node (``name, difficulty_level, description``; null when nothing is selected) from its neighbourhood (arrays of names).

    All prerequisites, three related nodes and two papers are named.
    """
    # The wording of the answer.
    name, chosen = F.coalesce(node["name"], F.lit("no active selection")), node.isNotNull()
    listed = lambda before, names, k, after: F.when(F.size(names) > 0, F.concat(F.lit(before), F.array_join(F.slice(names, 1, k), ", "), F.lit(after))).otherwise("")
    hello = F.concat(F.lit(f"Hi! I am your {assistant} tutor/assistant. You asked about **"), message, F.lit("** while focusing on the concept **"), name, F.lit("**.\n\n"))
    told = F.concat(
        F.lit("Here is how this node links to other elements in the database:\n- **Focus Node**: "), name, F.lit(" ("), node["difficulty_level"], F.lit(" level). Description: "), node["description"], F.lit("\n"),
        F.when(F.size(prerequisites) > 0, F.concat(F.lit("- **Prerequisite Chain**: It depends on covering **"), F.array_join(prerequisites, ", "), F.lit("** first.\n"))).otherwise(
            "- **Prerequisite Chain**: No immediate prerequisite dependencies mapped. It is a great place to start!\n"
        ),
        listed("- **Adjacent Paths**: Related expansions include **", related, 3, "**.\n"),
        listed("- **Grounding Literature**: Key papers using or extending this method include: *", papers, 2, "*.\n"),
        F.lit("\nIn relation to your query, we can observe that "), name,
        F.lit(" acts as a key conceptual step. Would you like me to map out a step-by-step learning path from its prerequisites to advanced implementations?"),
    )
    nothing = F.lit(
        "I see that you haven't selected a node on the canvas. Based on general knowledge, this concept represents a key building block. "
        "To see how it connects in your uploaded documents, try clicking an element on the graph!"
    )
    return F.concat(hello, F.when(chosen, told).otherwise(nothing))


def answer_or_fallback(live: Column, error: Column, offline: Column) -> Column:
    """What a model has said; if it broke off with an error, a notice and the offline answer follow."""
    # The wording of the notice.
    notice = F.concat(F.lit("\n*(Notice: Live API call failed due to: "), error, F.lit(". Falling back to mock assistant explanation)*\n\n"))
    return F.when(error.isNull(), live).otherwise(F.concat(F.coalesce(live, F.lit("")), notice, offline))


def append_chunks(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Streamed ``chunks(conv_id, n, chunk)`` joined to the last message of their conversation, in order, if that is the assistant's.

    ``messages(conv_id, turn, role, text)``; others, and conversations without chunks, stay as they are.
    """
    more = chunks.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "chunk"))), lambda x: x["chunk"]), "").alias("_more"))
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    rows = messages.join(last, "conv_id").join(more, "conv_id", "left")
    own = (F.col("turn") == F.col("_last")) & (F.col("role") == "assistant")
    return rows.withColumn("text", F.when(own, F.concat("text", F.coalesce("_more", F.lit("")))).otherwise(F.col("text"))).select(*messages.columns)

"""Queries on a property graph held as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EXPAND_TYPES, UTILITY_LABELS, blank_to_null, display_name
from ..storage import discard, materialise
from .components import connected_components, numbered_components
from .paths import longest_chains, ordered_links, simple_chains, upstream


@dataclass(frozen=True)
class PropertyGraph:
    """``nodes(id, label, name, title, description, difficulty_level, doc_id, session_id, ...)`` and ``edges(src, dst, type, doc_id, session_id)``."""

    nodes: DataFrame
    edges: DataFrame

    # ---- scopes -------------------------------------------------------------------------------------------------

    def session(self, session_id: str) -> PropertyGraph:
        """Nodes and edges that carry the session. Links without a scope are not crossed."""
        return PropertyGraph(self.nodes.where(F.col("session_id") == session_id), self.edges.where(F.col("session_id") == session_id))

    def members(self, document_id: str, everything: str | None = "doc-1") -> DataFrame:
        """Ids in a document's scope: what it contains and what names it; the document ``everything`` holds all but documents."""
        if everything is not None and document_id == everything:
            return self.nodes.where("label != 'Document'").select("id").distinct()
        held = self.edges.where((F.col("src") == document_id) & (F.col("type") == "CONTAINS")).select(F.col("dst").alias("id"))
        named = self.nodes.where(F.col("doc_id") == document_id).select("id")
        return held.unionByName(named).distinct()

    def document(self, document_id: str) -> PropertyGraph:
        """Members of a document and the edges among them that belong to it."""
        nodes = self.nodes.join(self.members(document_id), "id", "left_semi")
        return PropertyGraph(nodes, self.edges.where(F.col("doc_id") == document_id)).induced()

    def induced(self, by_first: bool = False) -> PropertyGraph:
        """Edges with both ends among the nodes, on any of them but utility links' scope.

        ``by_first``: edges that have an end whose first character begins no id of the nodes are left out before anything is shuffled, for one more reading of the nodes.
        """
        ids, edges = self.nodes.select("id"), self.edges
        if by_first:
            firsts = F.broadcast(ids.select(F.substring("id", 1, 1).alias("first")).distinct())  # at most one row a character
            for end in ("dst", "src"):
                edges = edges.join(firsts, F.substring(end, 1, 1) == F.col("first"), "left_semi")
        kept = edges.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")
        return replace(self, edges=kept)

    def without(self, labels: tuple[str, ...]) -> PropertyGraph:
        return PropertyGraph(self.nodes.where(~F.col("label").isin(*labels)), self.edges).induced()

    def session_subgraph(self, session_id: str) -> PropertyGraph:
        """What a session shows: no documents, notes, highlights or citations."""
        return self.session(session_id).without(UTILITY_LABELS)

    def own_namespace(self, document_id: str, multi: bool = False) -> DataFrame:
        """Nodes that do not name another document, unless several documents are shown."""
        doc = F.col("doc_id")
        return self.nodes if multi else self.nodes.where(doc.isNull() | (doc == "") | (doc == document_id))

    def documents(self, session_id: str) -> DataFrame:
        """``id, title, status, progress_pct`` of a session's documents; a missing state is done, a missing or zero progress 100."""
        own = self.nodes.where((F.col("label") == "Document") & (F.col("session_id") == session_id))
        held = lambda c, kind: F.col(c) if c in self.nodes.columns else F.lit(None).cast(kind)
        pct = held("progress_pct", "int")
        return own.select(
            "id", F.coalesce(blank_to_null(F.col("title")), F.lit("Untitled Document")).alias("title"), F.coalesce(blank_to_null(held("status", "string")), F.lit("done")).alias("status"),
            F.coalesce(F.when(pct != 0, pct), F.lit(100)).cast("int").alias("progress_pct"),
        )

    def first_topic(self, document_id: str | None = None) -> DataFrame:
        """``id, name`` of the first topic, by id, of all nodes or of a document."""
        nodes = self.nodes if document_id is None else self.nodes.join(self.members(document_id), "id", "left_semi")
        return nodes.where("label = 'Topic'").agg(F.min_by(F.struct("id", "name"), "id").alias("t")).where("t is not null").select("t.id", "t.name")

    # ---- nodes --------------------------------------------------------------------------------------------------

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id).select(
            "id", "label", display_name(F.col("name"), F.col("title")).alias("name"), F.coalesce("description", F.lit("")).alias("description"),
            F.coalesce(F.when(F.col("difficulty_level") != "", F.col("difficulty_level")), F.lit("Beginner")).alias("difficulty_level"), "doc_id", "session_id",
        )

    def ownership(self, node_ids: DataFrame, session_id: str) -> DataFrame:
        """``id, status``: OK in the session, FORBIDDEN elsewhere only, NOT_FOUND nowhere."""
        seen = self.nodes.groupBy("id").agg(F.max((F.col("session_id") == session_id).cast("int")).alias("own"), F.count("*").alias("n"))
        status = F.when(F.col("own") == 1, "OK").when(F.col("n") > 0, "FORBIDDEN").otherwise("NOT_FOUND")
        return node_ids.join(seen, "id", "left").select("id", status.alias("status"))

    # ---- traversal ----------------------------------------------------------------------------------------------

    def _from(self, frontier: DataFrame, mode: str) -> DataFrame:
        """``src, dst, type, there``: links of the ids ``here`` of a frontier, original orientation kept; the other end must be a node of this scope.

        ``basic`` follows incoming prerequisites, ``any`` all links in both directions, any other mode those of the shown types. Only links that touch the
        frontier, and the nodes at their other ends, are looked at.
        """
        kept = self.edges if mode == "any" else self.edges.where(F.col("type") == "PREREQUISITE_OF") if mode == "basic" else self.edges.where(F.col("type").isin(*EXPAND_TYPES))
        kept = kept.select("src", "dst", "type")
        near = kept.join(frontier, F.col("dst") == F.col("here")).select("src", "dst", "type", F.col("src").alias("there"))
        if mode != "basic":
            near = near.unionByName(kept.join(frontier, F.col("src") == F.col("here")).select("src", "dst", "type", F.col("dst").alias("there")))
        return near.distinct().join(self.nodes.select(F.col("id").alias("there")).distinct(), "there", "left_semi")

    def expand(self, target: str, depth: int = 1, mode: str = "basic", cap: int | None = 150) -> tuple[DataFrame, DataFrame]:
        """(nodes with their hop, edges) on paths of at most ``depth`` hops from a node.

        ``basic`` follows incoming prerequisites, any other mode undirected links. The nearest ``cap`` nodes are kept (ties by id), with
        the edges among them.
        """
        if not 1 <= depth <= 3:
            raise ValueError("depth is 1 to 3")
        reached = self.nodes.where(F.col("id") == target).select("id", F.lit(0).alias("hop")).limit(1)
        frontier, edges = reached, None
        for hop in range(1, depth + 1):
            near = materialise(self._from(frontier.select(F.col("id").alias("here")), mode), "hop", light=True)
            frontier = near.select(F.col("there").alias("id")).distinct().join(reached.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
            reached = reached.unionByName(frontier)
            edges = near.select("src", "dst", "type") if edges is None else edges.unionByName(near.select("src", "dst", "type"))
        reached = reached.groupBy("id").agg(F.min("hop").alias("hop"))
        edges = edges.distinct()
        nodes = reached
        if cap is not None:
            nodes = reached.orderBy("hop", "id").limit(cap)
            ids = nodes.select("id")
            edges = edges.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")
        return nodes, edges

    def neighbours(self, target: str, mode: str = "any") -> DataFrame:
        """One hop in either direction: ``id, type, out`` (documents' own links left out)."""
        e = self.edges.where("type != 'CONTAINS'") if mode == "any" else self.edges.where("type = 'PREREQUISITE_OF'")
        out = e.where(F.col("src") == target).select(F.col("dst").alias("id"), "type", F.lit(True).alias("out"))
        back = e.where(F.col("dst") == target).select(F.col("src").alias("id"), "type", F.lit(False).alias("out"))
        return out.unionByName(back).distinct()

    def shortest_path(self, start: str, goal: str, max_hops: int = 10) -> list[str]:
        """Ids of the shortest undirected path, the least in id order of those; empty if there is none."""
        seen = materialise(self.nodes.where(F.col("id") == start).select("id", F.array("id").alias("path")).limit(1), "bfs", light=True)
        frontier, used = seen, [seen]
        found: list[str] = []
        for _ in range(max_hops + 1):
            hit = frontier.where(F.col("id") == goal).select("path").first()
            if hit or frontier.isEmpty():
                found = list(hit["path"]) if hit else []
                break
            pairs = self._from(frontier.select(F.col("id").alias("here")), "any").select("src", "dst", "there")
            back = F.when(F.col("there") == F.col("src"), F.col("dst")).otherwise(F.col("src"))
            nxt = pairs.select(back.alias("id"), "there").distinct().join(frontier, "id").select(F.col("there").alias("id"), F.concat("path", F.array("there")).alias("path"))
            nxt = nxt.groupBy("id").agg(F.min("path").alias("path")).join(seen.select("id"), "id", "left_anti")
            frontier = materialise(nxt, "bfs", light=True)
            used.append(frontier)
            seen = seen.unionByName(frontier)
        for df in used:
            discard(df)
        return found

    def prerequisite_paths(self, target: str, max_hops: int = 5) -> DataFrame:
        """All simple prerequisite chains that end at a node: ``path`` (from its start), ``hops``, ``root`` (nothing precedes the start anywhere).

        There are at most ``prerequisites ** max_hops`` of them, all of which are listed: the bound on hops is part of the question.
        """
        ids = self.nodes.select("id").distinct()
        links = self.edges.where("type = 'PREREQUISITE_OF'").select("src", "dst").distinct().join(ids, F.col("src") == F.col("id"), "left_semi")
        level = ids.where(F.col("id") == target).select(F.array("id").alias("path"))
        levels = [level]
        for _ in range(max_hops):
            level = level.join(links, F.col("dst") == F.element_at("path", 1)).where(~F.array_contains("path", F.col("src"))).select(F.concat(F.array("src"), "path").alias("path"))
            levels.append(level)
        paths = levels[0]
        for more in levels[1:]:
            paths = paths.unionByName(more)
        preceded = self.edges.where("type = 'PREREQUISITE_OF'").select(F.col("dst").alias("start")).distinct().withColumn("preceded", F.lit(True))
        paths = paths.withColumn("start", F.element_at("path", 1)).withColumn("hops", F.size("path") - 1)
        return paths.join(preceded, "start", "left").select("path", "hops", F.col("preceded").isNull().alias("root"))

    def learning_path(self, target: str, max_hops: int = 5, prefer_root: bool = True) -> DataFrame:
        """``path, hops, root``: the longest simple chain of at most ``max_hops``; chains from a root first when asked for; ties by ids. A node without prerequisites is its own path.

        The first of ``prerequisite_paths``, without listing them, over the links within ``max_hops`` of the node: ``operators.paths.simple_chains`` carries a bounded number of chains for each node.
        """
        all_links = self.edges.where("type = 'PREREQUISITE_OF'").select("src", "dst")
        aim = self.nodes.where(F.col("id") == target).select("id").distinct()
        links = upstream(all_links, aim, self.nodes, max_hops)
        chains = simple_chains(links, aim, max_hops)
        hops = F.size("path") - 1
        first = materialise(chains.groupBy("start", hops.alias("hops")).agg(F.min_by("path", F.array_join("path", ">")).alias("path")), "firsts", light=True)
        discard(links)
        preceded = all_links.select(F.col("dst").alias("start")).join(first.select("start"), "start", "left_semi").distinct().withColumn("preceded", F.lit(True))
        paths = first.join(preceded, "start", "left").select("path", "hops", F.col("preceded").isNull().alias("root"))
        order = [F.desc(((F.col("hops") > 0) & F.col("root")).cast("int"))] if prefer_root else []
        return paths.orderBy(*order, F.desc("hops"), F.array_join("path", ">")).limit(1)

    def longest_learning_path(self, target: str, prefer_root: bool = True) -> DataFrame:
        """``path, hops, root``: the longest prerequisite chain that ends at a node, without a bound; chains from a root first when asked for, ties by ids in order.

        Links inside a strongly connected component tell no order and do not count (``operators.paths``); where there is no cycle it is the longest simple chain. Only what leads to
        the node is looked at. A node without prerequisites is its own path, an unknown one has none.
        """
        ids = self.nodes.select("id").distinct()
        links = self.edges.where("type = 'PREREQUISITE_OF'").select("src", "dst")
        known = materialise(links.join(ids, F.col("src") == F.col("id"), "left_semi").distinct(), "known")
        aim = ids.where(F.col("id") == target)
        ahead = materialise(ordered_links(upstream(known, aim)), "ordered")
        # a cycle's links may have been all that led on: chains go through what still reaches the node
        ahead = upstream(ahead, aim)
        discard(known)
        preceded = self.edges.where("type = 'PREREQUISITE_OF'").select(F.col("dst").alias("id")).distinct()
        starts = ahead.select(F.col("src").alias("id")).distinct().join(preceded, "id", "left_anti")
        best = longest_chains(ahead, starts, prefer_root).where(F.col("id") == target).select("path", "hops", "root")
        alone = aim.join(preceded.withColumn("preceded", F.lit(True)), "id", "left").select(F.array("id").alias("path"), F.lit(0).alias("hops"), F.col("preceded").isNull().alias("root"))
        return best.unionByName(alone).orderBy(F.desc("hops")).limit(1)

    def context(self, target: str, per_bucket: int = 10) -> DataFrame:
        """``bucket, rank, id, name`` of a node's neighbours: papers, prerequisites (incoming) and related, each at most ``per_bucket``."""
        near = self.neighbours(target).join(self.nodes.select("id", "label", display_name(F.col("name"), F.col("title")).alias("name")), "id")
        bucket = F.when(F.col("label") == "Paper", "papers").when((F.col("type") == "PREREQUISITE_OF") & ~F.col("out"), "prerequisites").otherwise("related")
        one = near.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.col("out"), "type"))).where("rn = 1")
        ranked = one.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("name", "id")))
        return ranked.where(F.col("rank") <= per_bucket).select("bucket", "rank", "id", "name")

    # ---- shape --------------------------------------------------------------------------------------------------

    def degrees(self) -> DataFrame:
        """``id, in_degree, out_degree, degree`` of every node."""
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
        count = ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        out = self.nodes.select("id").distinct().join(count, "id", "left").select("id", zero("in_degree"), zero("out_degree"))
        return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))

    def isolated(self) -> DataFrame:
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        return self.nodes.select("id").distinct().join(ends, "id", "left_anti")

    def roots(self) -> DataFrame:
        """Nodes with prerequisite links of which none comes in."""
        links = self.edges.where("type = 'PREREQUISITE_OF'")
        return links.select(F.col("src").alias("id")).distinct().join(links.select(F.col("dst").alias("id")), "id", "left_anti")

    def _componented(self) -> DataFrame | None:
        """``id, component, links`` of every node, stored; ``links`` counts its edges but loops. Ids travel as 64-bit hashes.

        Edges count as they are, so None is returned where one has an end that is no node, or where two ids share a hash.
        """
        key = lambda c: F.xxhash64(F.col(c))
        ends = self.edges.where("src is not null and dst is not null").select(key("src").alias("a"), key("dst").alias("b"))
        found, used = numbered_components(ends)
        ids = self.nodes.where("id is not null").select(key("id").alias("x"), "id").repartition("x").groupBy("x").agg(F.min("id").alias("id"), F.max("id").alias("other"))
        named = materialise(ids.join(found, "x", "full_outer").select("id", "c", "n", (F.col("id").isNull() | (F.col("id") != F.col("other"))).alias("amiss")), "named")
        for done in used:
            discard(done)
        if not named.where("amiss").isEmpty():
            discard(named)
            return None
        least = materialise(named.where("c is not null").groupBy("c").agg(F.min("id").alias("component")), "least", light=True)
        return named.join(least, "c", "left").select("id", F.coalesce("component", "id").alias("component"), F.coalesce("n", F.lit(0)).alias("links"))

    def components(self) -> DataFrame:
        """``id, component``: smallest id of the connected component, isolated nodes included."""
        found = self._componented()
        if found is None:  # the exact way for what is left
            g = self.induced()
            linked = connected_components(g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
            found = g.nodes.select("id").distinct().join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        return found.select("id", "component")

    def _neighbour_counts(self, of: DataFrame | None = None) -> DataFrame:
        """``id, deg``: how many other nodes each is linked with; ``of(id)``: only these nodes."""
        apart, end = self.edges.where("src != dst"), (lambda a, b: (F.col(a).alias("id"), F.col(b).alias("other")))
        one, other = apart.select(*end("src", "dst")), apart.select(*end("dst", "src"))
        pairs = one.unionByName(other) if of is None else one.join(of, "id", "left_semi").unionByName(other.join(of, "id", "left_semi"))
        return pairs.distinct().groupBy("id").agg(F.count("*").alias("deg"))

    def stitch(self, central: str) -> DataFrame:
        """Edges that link every other component to a central node: its member of most neighbours (ties by id), as ``RELATED_TO``.

        If the central node is missing, the component of the smallest id takes its place. A node has no more neighbours than edges, so only those with at least as many edges as the
        neighbours of a member of most edges are looked at.
        """
        comp = self._componented()
        if comp is None:
            comp = self.components()
            best = comp.join(self.induced()._neighbour_counts(), "id", "left")
        else:
            most = materialise(comp.groupBy("component").agg(F.min_by(F.struct("id", "links"), F.struct(-F.col("links"), "id")).alias("m")).select("component", "m.*"), "most", light=True)
            sure = most.where("links > 0").join(self._neighbour_counts(most.select("id")), "id").select("component", F.col("deg").alias("least"))
            sure = materialise(sure, "sure", light=True)
            able = materialise(comp.join(sure, "component").where("links >= least").select("id", "component"), "able", light=True)
            lone = most.where("links = 0").select("id", "component", F.lit(0).cast("long").alias("deg"))
            best = able.join(self._neighbour_counts(able.select("id")), "id", "left").select("id", "component", "deg").unionByName(lone)
            comp = most.select("component", F.col("component").alias("id")).unionByName(comp.where(F.col("id") == central).select("component", "id"))
        best = best.groupBy("component").agg(F.min_by("id", F.struct(-F.coalesce("deg", F.lit(0)), "id")).alias("member"))
        home = comp.agg(F.max(F.when(F.col("id") == central, F.col("component"))).alias("own"), F.min("component").alias("least"))
        hub = home.select(F.coalesce("own", "least").alias("home"), F.when(F.col("own").isNotNull(), F.lit(central)).otherwise(F.col("least")).alias("src"))
        one = hub.withColumn("one", F.lit(1))  # a single row
        return best.withColumn("one", F.lit(1)).join(F.broadcast(one), "one").where(F.col("component") != F.col("home")).select("src", F.col("member").alias("dst"), F.lit("RELATED_TO").alias("type"))


def path_edges(paths: DataFrame) -> DataFrame:
    """``pos, src, dst, type`` of the consecutive pairs of ``path``."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(i.alias("pos"), F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst")))
    return paths.where(F.size("path") > 1).select(F.explode(pairs).alias("e")).select("e.*", F.lit("PREREQUISITE_OF").alias("type"))


def narration(names: Column) -> Column:
    """A sentence for each step of a path of names."""
    # The wording of the narration.
    step = lambda x, i: (
        F.when(i == 0, F.concat(F.lit("First, build a solid foundation with **"), x, F.lit("**.")))
        .when(i == F.size(names) - 1, F.concat(F.lit("Finally, synthesize these tools to master the target concept **"), x, F.lit("**.")))
        .otherwise(F.concat(F.lit("Next, transition into **"), x, F.lit("** to expand your understanding of relevant concepts.")))
    )
    empty = F.lit("No prerequisite concepts found. You are ready to start with the target concept directly!")
    return F.when(F.size(names) == 0, empty).otherwise(F.array_join(F.transform(names, step), " "))


def paper_anchor(nodes: DataFrame, degrees: DataFrame, filename: str) -> tuple[DataFrame, DataFrame]:
    """(paper node, MENTIONS edge) for a graph without papers: titled from the file name, linked to its best-connected concept."""
    # The wording of titles and descriptions, the labels that can be an anchor.
    title = F.trim(F.regexp_replace(F.regexp_replace(F.lit(filename), "^[0-9a-fA-F-]{36}_", ""), "(?i)\\.pdf$", ""))
    title = F.when(title == "", "Uploaded Research Paper").otherwise(title)
    none = nodes.agg(F.count_if(F.col("label") == "Paper").alias("papers")).where("papers = 0")
    paper = none.select(title.alias("name"), F.lit("Paper").alias("label"), F.concat(F.lit("Source research paper for the extracted knowledge graph: "), title, F.lit(".")).alias("description"))
    able = nodes.where(F.col("label").isin("Topic", "Concept", "Method", "Dataset")).join(degrees.select("id", "degree"), "id")
    anchor = able.orderBy(F.desc("degree"), "id").limit(1).select(F.col("id").alias("dst"))
    anchor = anchor.withColumn("one", F.lit(1))  # a single row
    return paper, paper.select(F.col("name").alias("src"), F.lit(1).alias("one")).join(F.broadcast(anchor), "one").select("src", "dst", F.lit("MENTIONS").alias("type"))

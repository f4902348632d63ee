"""Longest chains of links without a bound on their length.

A longest simple path is only a matter of counting where links form no cycle. Links inside a strongly connected component put its nodes before one another both ways,
so they tell no order and are left out (``ordered_links``); what is left has no cycle, and the best chain of each node follows from those of its predecessors
(``longest_chains``) in topological rounds.

With a bound on hops, simple chains can be told among cycles as well: ``simple_chains`` keeps of each node's chains a few that stand for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, materialise


#: Links along which a task spreads values at once.
_SLICE = 1 << 21


def risen(a, b, value) -> list:
    """Raises ``value``, whole numbers of nodes, to the greatest of those that lead to each along links from ``a`` to ``b``; the nodes that rose, some more than once."""
    import numpy as np

    by = np.argsort(a, kind="stable")
    b, first = b[by], np.searchsorted(a[by], np.arange(len(value) + 1))
    moved, rose = np.flatnonzero(value >= 0), []
    while len(moved):
        n = np.diff(first)[moved]
        at = np.repeat(first[moved] - np.cumsum(n) + n, n) + np.arange(n.sum())
        told, to = np.repeat(value[moved], n), b[at]
        higher = told > value[to]
        np.maximum.at(value, to[higher], told[higher])
        moved = np.unique(to[higher])
        rose.append(moved)
    return rose


def _spread_slices(batches: Iterator) -> Iterator:
    """``id, c`` of each node whose value rises within a slice of links ``a, b`` with the values ``ca, cb`` of their ends."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def out(held):
        links = pa.Table.from_batches(held)
        coded = pa.chunked_array([chunk for c in ("a", "b", "ca", "cb") for chunk in links.column(c).chunks]).combine_chunks().dictionary_encode()
        texts, order = coded.dictionary, pc.sort_indices(coded.dictionary)
        rank = np.empty(len(texts) + 1, dtype=np.int64)
        rank[order.to_numpy()], rank[-1] = np.arange(len(texts)), -1
        a, b, ca, cb = np.split(rank[pc.fill_null(coded.indices, -1).to_numpy()], 4)
        value = np.full(len(texts), -1)
        np.maximum.at(value, a, ca)
        np.maximum.at(value, b, cb)
        up = np.unique(np.concatenate(risen(a, b, value) or [a[:0]]))
        texts = texts.take(order)
        yield from pa.table({"id": texts.take(pa.array(up)), "c": texts.take(pa.array(value[up]))}).to_batches(1 << 16)

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _SLICE:
            yield from out(held)
            held, rows = [], 0
    if rows:
        yield from out(held)


def spread(links: DataFrame, start: DataFrame) -> DataFrame:
    """``id, c``: the greatest ``c`` of ``start(id, c)`` that leads to each node along ``links(a, b)``, its own included; nodes that none reaches are left out.

    In a round each task spreads values along a slice of the links until they rest, and the slices tell one another what rose: one round, and one that finds nothing more, where the links
    fit a slice, and never more than the steps it takes a link at a time.
    """
    slices = links.count() // _SLICE + 1
    now = materialise(start.where("id is not null and c is not null").groupBy("id").agg(F.max("c").alias("c")), "spread")
    while True:
        told = links.join(now.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a", "left").join(now.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b", "left")
        rose = told.select("a", "b", "ca", "cb").coalesce(slices).mapInArrow(_spread_slices, "id string, c string")
        rose = materialise(rose.groupBy("id").agg(F.max("c").alias("c")), "rose")
        if rose.isEmpty():
            discard(rose)
            return now
        nxt = materialise(now.unionByName(rose).groupBy("id").agg(F.max("c").alias("c")), "spread")
        discard(now)
        discard(rose)
        now = nxt


def upstream(links: DataFrame, targets: DataFrame, nodes: DataFrame | None = None, max_hops: int | None = None) -> DataFrame:
    """The links ``src, dst`` on chains that end at one of ``targets(id)``; a round for each step away from them, at most ``max_hops``, or those of ``spread`` without a bound.

    ``nodes(id)``: only links from one of these count. ``links`` and ``nodes`` are looked through in every round, and only what touches the last step's nodes is shuffled.
    """
    if nodes is None and max_hops is None:
        seen = spread(links.select(F.col("dst").alias("a"), F.col("src").alias("b")), targets.select("id", F.col("id").alias("c")))
        found = materialise(links.join(seen, F.col("dst") == F.col("id"), "left_semi").select("src", "dst").distinct(), "links")
        discard(seen)
        return found
    seen = materialise(targets.select("id").distinct(), "upstream", light=True)
    edge, parts, hops = seen, [seen], 0
    while max_hops is None or hops < max_hops:
        hops += 1
        step = links.join(edge, F.col("dst") == F.col("id"), "left_semi").select(F.col("src").alias("id")).distinct()
        asked = None
        if nodes is not None:
            asked = materialise(step, "asked", light=True)
            step = nodes.select("id").join(asked, "id", "left_semi").distinct()
        edge = materialise(step.join(seen, "id", "left_anti"), "upstream", light=True)
        discard(asked)
        parts.append(edge)
        if edge.isEmpty():
            break
        seen = parts[0]
        for more in parts[1:]:
            seen = seen.unionByName(more)
    found = links.join(seen, F.col("dst") == F.col("id"), "left_semi").select("src", "dst").distinct()
    if nodes is not None:
        found = found.join(seen, F.col("src") == F.col("id"), "left_semi")
    found = materialise(found, "links")
    for done in parts:
        discard(done)
    return found


def _greatest(links: DataFrame) -> DataFrame:
    """``id, c``: the greatest id that reaches each node, its own included."""
    ends = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return spread(links.select(F.col("src").alias("a"), F.col("dst").alias("b")), ends.select("id", F.col("id").alias("c")))


def _returning(links: DataFrame, colour: DataFrame) -> DataFrame:
    """``id, component``: nodes that lead to the node named by their colour, along nodes of that colour."""
    inside = links.join(colour.select(F.col("id").alias("src"), "c"), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("d")), "dst").where("c = d")
    inside = materialise(inside.select(F.col("dst").alias("a"), F.col("src").alias("b")), "inside")
    found = spread(inside, colour.where("id = c"))
    discard(inside)
    return found.select("id", F.col("c").alias("component"))


def strong_components(links: DataFrame) -> DataFrame:
    """``id, component`` of every end of ``links(src, dst)``: the greatest id among the nodes that reach one another.

    Forward and backward colouring: each node takes the greatest id that reaches it; the nodes that lead back to the one with that id, within its colour, are a component.
    Those are taken out and the rest is coloured again. Nodes before or after all cycles are taken off first, so rounds go by the extent of what is cyclic.
    """
    links = materialise(links.where("src != dst").select("src", "dst").distinct(), "scc")
    nodes = materialise(links.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "scc-nodes", light=True)
    live, parts = links, []
    while True:
        # what has no link in, or none out, is a component of its own
        while True:
            ins, outs = live.select(F.col("dst").alias("id")).distinct(), live.select(F.col("src").alias("id")).distinct()
            core = ins.join(outs, "id", "left_semi")
            kept = live.join(core.withColumnRenamed("id", "src"), "src", "left_semi").join(core.withColumnRenamed("id", "dst"), "dst", "left_semi")
            kept = materialise(kept.select("src", "dst"), "scc")
            whole = kept.count() == live.count()
            if live is not links:
                discard(live)
            live = kept
            if whole:
                break
        if live.isEmpty():
            break
        colour = _greatest(live)
        part = _returning(live, colour)
        discard(colour)
        parts.append(part)
        gone = part.select("id")
        rest = live.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        rest = materialise(rest.select("src", "dst"), "scc")
        discard(live)
        live = rest
    out = nodes.withColumn("component", F.col("id"))
    if parts:
        found = parts[0]
        for more in parts[1:]:
            found = found.unionByName(more)
        out = nodes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return out


def ordered_links(links: DataFrame) -> DataFrame:
    """``src, dst`` without self-loops and links inside a strongly connected component: no cycle is left."""
    of = materialise(strong_components(links), "strong", light=True)
    one = links.where("src != dst").select("src", "dst").distinct().join(of.select(F.col("id").alias("src"), F.col("component").alias("a")), "src")
    return one.join(of.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst").where("a != b").select("src", "dst")


def longest_chains(links: DataFrame, roots: DataFrame, prefer_root: bool = True) -> DataFrame:
    """``id, root, hops, path`` for every end of acyclic ``links``: the best chain that ends there.

    Chains from one of ``roots(id)`` come first when ``prefer_root``, then longer ones, then those whose ids come first, one after another. Topological rounds: a node is settled
    once all links into it have been followed, each link is followed once, and only the best chain of a node goes on.
    """
    ends = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    first = ends.join(links.select(F.col("dst").alias("id")), "id", "left_anti").join(roots.select("id").distinct().withColumn("is_root", F.lit(True)), "id", "left")
    fresh = materialise(first.select("id", F.coalesce("is_root", F.lit(False)).alias("root"), F.lit(0).alias("hops"), F.array("id").alias("path")), "chains")
    order = F.struct((~F.col("root")).cast("int") if prefer_root else F.lit(0), -F.col("hops"), "path")
    live, waiting, settled = materialise(links.select("src", "dst"), "ahead"), None, [fresh]
    while not fresh.isEmpty():
        sent = live.join(fresh.select(F.col("id").alias("src"), "root", (F.col("hops") + 1).alias("hops"), "path"), "src")
        sent = sent.select(F.col("dst").alias("id"), "root", "hops", "path")
        sent = sent if waiting is None else sent.unionByName(waiting)
        held = materialise(sent.groupBy("id").agg(F.min_by(F.struct("root", "hops", "path"), order).alias("b")).select("id", "b.*"), "held")
        ahead = materialise(live.join(fresh.select(F.col("id").alias("src")), "src", "left_anti").select("src", "dst"), "ahead")
        open_ = ahead.select(F.col("dst").alias("id")).distinct()
        fresh = materialise(held.join(open_, "id", "left_anti").select("id", "root", "hops", F.concat("path", F.array("id")).alias("path")), "chains")
        after = materialise(held.join(open_, "id", "left_semi").select("id", "root", "hops", "path"), "held")
        for done in (live, waiting, held):
            discard(done)
        live, waiting = ahead, after
        settled.append(fresh)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def representatives(paths: list[list[str]], left: int) -> list[list[str]]:
    """Of simple chains with one start, one end and one length, those that stand for all where at most ``left`` nodes are still to come.

    Whatever ``left`` nodes or fewer are put before the start, if a chain has none of them then a kept one, not after it in order, has none of them. A tree finds them: the first
    chain of all, then for each of its inner nodes the first chain without that node, and so on ``left`` levels deep; chains of ``k`` inner nodes leave at most
    ``1 + k + ... + k ** left``, however many there are.
    """
    ranked = sorted(paths, key=">".join)
    inner = [frozenset(p[1:-1]) for p in ranked]
    kept, seen, todo = set(), {frozenset()}, [(frozenset(), left)]
    while todo:
        without, depth = todo.pop()
        first = next((i for i, nodes in enumerate(inner) if not nodes & without), None)
        if first is None:
            continue
        kept.add(first)
        for node in inner[first] if depth else ():
            more = without | {node}
            if more not in seen:
                seen.add(more)
                todo.append((more, depth - 1))
    return [ranked[i] for i in sorted(kept)]


def _standing(level: DataFrame, left: int) -> DataFrame:
    """``representatives`` of each ``start``: in each batch before the shuffle, so that a start with very many chains sends few, and again where they meet."""

    def thin(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            of: dict[str, list] = {}
            for path in batch.column("path").to_pylist():
                of.setdefault(path[0], []).append(path)
            kept = [p for group in of.values() for p in representatives(group, left)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in kept], pa.string()), pa.array(kept, pa.list_(pa.string()))], names=["start", "path"])

    def meet(table):
        import pyarrow as pa

        return pa.Table.from_batches(list(thin(table.combine_chunks().to_batches())), table.schema)

    kind = "start string, path array<string>"
    return level.select("start", "path").mapInArrow(thin, kind).groupBy("start").applyInArrow(meet, kind)


def simple_chains(links: DataFrame, targets: DataFrame, max_hops: int) -> DataFrame:
    """``start, path`` of simple chains of ``links(src, dst)`` of at most ``max_hops`` links that end at one node, ``targets(id)``.

    For each start and length the first chain in order of ``path`` is among them, and all others that a longer chain's first could go on through; not every chain is. A round for each hop;
    it carries a number of chains for each node that depends on ``max_hops`` alone, where listing all takes ``prerequisites ** max_hops``.
    """
    links = links.where("src != dst").select("src", "dst").distinct()
    level = materialise(targets.select(F.col("id").alias("start"), F.array("id").alias("path")), "level", light=True)
    levels = [level]
    for hops in range(1, max_hops + 1):
        grown = level.join(links, F.col("dst") == F.col("start")).where(~F.array_contains("path", F.col("src")))
        grown = grown.select(F.col("src").alias("start"), F.concat(F.array("src"), "path").alias("path"))
        left, text = max_hops - hops, F.array_join("path", ">")
        if hops > 1 and not left:
            grown = grown.groupBy("start").agg(F.min_by("path", text).alias("path"))
        elif hops == 2:  # one inner node each: the first chains that differ in it are simply the first
            grown = grown.withColumn("n", F.row_number().over(Window.partitionBy("start").orderBy(text))).where(F.col("n") <= left + 1).drop("n")
        elif hops > 2:
            grown = _standing(grown, left)
        level = materialise(grown, "level", light=True)
        if level.isEmpty():
            discard(level)
            break
        levels.append(level)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out

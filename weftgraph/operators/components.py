"""Connected components: slices of edges are contracted where they lie, what is left by star rewrites."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, materialise

#: Edges that a task contracts at once.
_SLICE = 1 << 21


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every endpoint of ``edges(a, b)``: component is the smallest id reachable.

    Alternating large-star and small-star rewrites: rows stay linear in the edges, hubs are pre-aggregated with
    ``min`` before anything is joined, and the number of rounds grows with the logarithm of the diameter; an error says so when
    they do not suffice. Only one number (a checksum of the edge set) reaches the driver in a round.
    """
    cur = materialise(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc", light=True
    )
    seen = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low2, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a != b")
            .distinct()
        )
        nxt = materialise(small, "cc", light=True)
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(cur)
        cur = nxt
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        discard(cur)
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    star = cur.groupBy("a").agg(F.min("b").alias("component"))
    roots = cur.select(F.col("b").alias("id")).distinct().join(star.select(F.col("a").alias("id")), "id", "left_anti")
    return star.select(F.col("a").alias("id"), "component").unionByName(roots.select("id", F.col("id").alias("component")))


def least_linked(a, b) -> tuple:
    """``ids, least, n`` as arrays: the different ends of edges between whole numbers, the least one each is linked with, and how many edges touch each (a loop none)."""
    import numpy as np

    loop = a == b
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([~loop, ~loop]), minlength=len(ids)).astype(np.int64)
    u, v = at[: len(a)], at[len(a) :]
    least = np.arange(len(ids))
    while len(u):
        low, high = np.minimum(u, v), np.maximum(u, v)
        least[high] = low  # one of the lower ends of each: no cycle can come of it
        while True:
            nearer = least[least]
            if np.array_equal(nearer, least):
                break
            least = nearer
        u, v = least[low], least[high]
        apart = u != v
        u, v = u[apart], v[apart]
    return ids, ids[least], n


def _contract(batches: Iterator) -> Iterator:
    """``x, r, n`` of each end in each slice of ``a, b``: see ``least_linked``."""
    import numpy as np
    import pyarrow as pa

    def out(held):
        a, b = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b"))
        yield from pa.table(dict(zip("xrn", least_linked(a, b), strict=True))).to_batches(1 << 16)

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _SLICE:
            yield from out(held)
            held, rows = [], 0
    if rows:
        yield from out(held)


def numbered_components(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """((x, c, n) for every endpoint of ``edges(a, b)`` of whole numbers, tables to discard): ``c`` is one of the numbers reachable, the same for all of them; ``n`` counts the edges that are no loops.

    Each task contracts its edges in slices and so leaves a row for each end in each slice; where an end meets itself from several slices it takes the least of their roots, and only links among roots
    go on. Where neighbours lie near one another that is all but nothing. It is done again as long as links fall to a half or less; then star rewrites take over.
    """
    of, cur, before, used = None, edges, None, []
    levels = []
    while True:
        stars = cur.mapInArrow(_contract, "x long, r long, n long")
        own = Window.partitionBy("x")
        met = stars.select("x", "r", "n", F.min("r").over(own).alias("m"), F.sum("n").over(own).alias("all"), F.row_number().over(own.orderBy("r")).alias("k"))
        # a row for each end, and one for each further root of its
        met = met.where("k = 1 or r != m").select((F.col("k") == 1).alias("end"), F.when(F.col("k") == 1, F.col("x")).otherwise(F.col("r")).alias("x"), "m", F.when(F.col("k") == 1, F.col("all")).alias("n"))
        met = materialise(met, "met")
        used.append(met)
        levels.append(met.where("end").select("x", "m", "n"))
        cur = met.where("not end").select(F.col("x").alias("a"), F.col("m").alias("b"))
        left = cur.count()
        if not left or (before is not None and left * 2 > before):
            break
        before = left
    if left:
        of = materialise(connected_components(cur), "roots")
        used.append(of)
        of = of.select(F.col("id").alias("m"), F.col("component").alias("c"))
    for level in reversed(levels):
        found = level.withColumn("c", F.col("m")) if of is None else level.join(of, "m", "left").withColumn("c", F.coalesce("c", "m"))
        of = found.select(F.col("x").alias("m"), "c")
    return found.select("x", "c", "n"), used

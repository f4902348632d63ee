"""How far the sources of a language diverge from one another, by their terms.

Terms of a text are its runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A language keeps the terms that ``min_docs`` of its documents have.
Every source of it (and the language as a whole) gives each kept term a smoothed share ``p = 1 + floor(UNIT * (count + 1) / (N + V))``; the divergence
of p from q is ``floor((p - q)^2 / q)``, summed over all kept terms. Whole numbers throughout.

1. One pass over the texts: slices of a batch tally their terms, by document and then by language and source, and the tallies are summed, in each task before
   the shuffle.
2. Each kept term becomes its *profile*, the sorted (source, count) list. Terms with one profile are one row with a multiplicity, which takes in most of the
   vocabulary: rare terms are alike.
3. Profiles yield, for each pair of sources that share them, a joint histogram of (count, count); cells with a zero on one side or both are implied by the
   counts of either source and of the language, and are filled in as differences, so that no term is set against a source that lacks it.
4. The divergence is evaluated once for each cell and each direction, times the cell's multiplicity.

A pair of sources gives one row of the result, so the work of steps 3 and 4 is bounded by pairs times different counts, whatever the number of documents.

Defined results: null text, language or source are empty strings; a group without kept terms has a value of 0 for each other source and no terms; a
language with one source has no pairs; rows count as often as they are there; other columns are ignored; an empty table gives an empty result. A text takes some
thirty times its size in memory, and a profile is as long as a language has sources.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialise
from .textcore import frugal

UNIT = 1_000_000_000
#: Bytes of text whose terms are tallied together.
SLICE = 2 << 20


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents; a row with a null term stands for each group that has documents without terms."""
    empty = F.lit("")
    src = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), F.coalesce("text", empty).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from . import textcore as tc

        fold = np.arange(256, dtype=np.uint8)
        fold[ord("A") : ord("Z") + 1] += 32
        gap = np.ones(256, bool)
        gap[0x80:] = gap[ord("A") : ord("Z") + 1] = gap[ord("a") : ord("z") + 1] = False
        for part in (part for batch in batches for part in tc.slices(batch, "text", SLICE)):
            lang, source = part.column(0).dictionary_encode(), part.column(1).dictionary_encode()
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            raw, off, _ = tc.buffers(part.column(2))
            start, end, first = tc.words(raw, off, gap)
            has = np.diff(first)
            ends = np.concatenate([[0], np.cumsum(end - start)])
            data = fold[raw[~gap[raw]]] if len(raw) else np.empty(0, np.uint8)
            terms = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
            size = max(len(terms.dictionary), 1)
            # first by document, then by group
            own, times = np.unique(np.repeat(np.arange(len(has)), has) * size + terms.indices.to_numpy(), return_counts=True)
            key, at = np.unique(group[own // size] * size + own % size, return_inverse=True)
            bare = np.unique(group[has == 0])
            where = np.concatenate([key // size, bare])
            none = pa.nulls(len(bare), pa.string())
            zeros = np.zeros(len(bare), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(where // len(source.dictionary))), source.dictionary.take(pa.array(where % len(source.dictionary))),
                    pa.concat_arrays([terms.dictionary.take(pa.array(key % size)).cast(pa.string()), none]),
                    pa.array(np.concatenate([np.bincount(at, weights=times, minlength=len(key)).astype(np.int64), zeros])),
                    pa.array(np.concatenate([np.bincount(at, minlength=len(key)).astype(np.int64), zeros])),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )

    counted = src.mapInArrow(frugal(run), "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(UNIT * (count + 1) / (total + kept))``; the product may pass 64 bits, so it is a decimal. The quotient is at most ``UNIT``."""
    part = F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return 1 + F.call_function("div", part, (total + kept).cast("decimal(20,0)"))


def distance(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / q)``: the square is at most 10^18."""
    return F.call_function("div", (p - q) * (p - q), q)


def profiles(counts: DataFrame, min_docs: int = 3) -> DataFrame:
    """``lang, term, n, profile``: kept terms with their occurrences in the language and, sorted, in each source that has them."""
    by_term = counts.where("term is not null").groupBy("lang", "term")
    by_term = by_term.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("profile"))
    return by_term.where(F.col("docs") >= min_docs).select("lang", "term", "n", "profile")


def audited(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """``lang, source, total, lang_total, kept``: every group, its occurrences of kept terms, those of its language and how many terms that keeps."""
    held = terms.select("lang", F.explode("profile").alias("p")).groupBy("lang", F.col("p.source").alias("source")).agg(F.sum("p.n").alias("total"))
    whole = terms.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("kept"))
    groups = counts.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(whole, "lang", "left")
    none = F.lit(0).cast("long")
    return groups.select("lang", "source", *[F.coalesce(c, none).alias(c) for c in ("total", "lang_total", "kept")])


def histograms(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, a, b, count_a, count_b, m``: for each pair of sources a < b, how many kept terms have these counts in them, cells of zeros included."""
    alike = materialise(terms.groupBy("lang", "profile").agg(F.count("*").alias("m")), "profiles")
    one = alike.select("lang", "profile", "m", F.posexplode("profile").alias("at", "x"))
    both = one.select("lang", "m", "x", F.explode_outer(F.slice("profile", F.col("at") + 2, F.size("profile"))).alias("y")).where("y is not null")
    pair = ["lang", "a", "b"]
    joint = both.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.col("x.n").alias("count_a"), F.col("y.n").alias("count_b")).agg(F.sum("m").alias("m"))
    single = alike.select("lang", "m", F.explode("profile").alias("x")).groupBy("lang", F.col("x.source").alias("source"), F.col("x.n").alias("n")).agg(F.sum("m").alias("m"))

    zero = F.lit(0).cast("long")
    cell = lambda a, b, m: F.struct(a.alias("count_a"), b.alias("count_b"), m.alias("m"))
    a, b, m = F.col("count_a"), F.col("count_b"), F.col("m")
    # a shared cell takes its terms from the cells that the two sources' own counts would put them into
    met = joint.select(*pair, F.explode(F.array(cell(a, b, m), cell(a, zero, -m), cell(zero, b, -m), cell(zero, zero, m))).alias("c"))
    members = groups.select("lang", "source", "kept")
    pairs = members.select("lang", F.col("source").alias("a"), "kept").join(members.select("lang", F.col("source").alias("b")), "lang").where("a < b")
    own_a = pairs.join(single.select("lang", F.col("source").alias("a"), "n", "m"), ["lang", "a"])
    own_b = pairs.join(single.select("lang", F.col("source").alias("b"), "n", "m"), ["lang", "b"])
    alone_a = own_a.select(*pair, F.explode(F.array(cell(F.col("n"), zero, m), cell(zero, zero, -m))).alias("c"))
    alone_b = own_b.select(*pair, F.explode(F.array(cell(zero, F.col("n"), m), cell(zero, zero, -m))).alias("c"))
    rest = pairs.select(*pair, cell(zero, zero, F.col("kept")).alias("c"))
    cells = met.unionByName(alone_a).unionByName(alone_b).unionByName(rest).select(*pair, "c.*")
    return cells.groupBy(*pair, "count_a", "count_b").agg(F.sum("m").alias("m")).where("m != 0 or (count_a = 0 and count_b = 0)")


def pair_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: divergence of each source from each other source of its language."""
    cells = histograms(terms, groups)
    own = lambda side: groups.select("lang", F.col("source").alias(side), F.col("total").alias(f"total_{side}"))
    cells = cells.join(own("a"), ["lang", "a"]).join(own("b").join(groups.select("lang", "kept").distinct(), "lang"), ["lang", "b"])
    # without kept terms there is one cell, of multiplicity 0
    kept = F.greatest(F.col("kept"), F.lit(1))
    cells = cells.withColumn("p", share(F.col("count_a"), F.col("total_a"), kept)).withColumn("q", share(F.col("count_b"), F.col("total_b"), kept))
    wide = lambda f: F.sum(f.cast("decimal(19,0)") * F.col("m").cast("decimal(18,0)")).cast("long")
    sums = cells.groupBy("lang", "a", "b").agg(wide(distance(F.col("p"), F.col("q"))).alias("ab"), wide(distance(F.col("q"), F.col("p"))).alias("ba"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("ab").alias("value")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("ba").alias("value")))
    return sums.select("lang", F.explode(ways).alias("w")).select("lang", "w.*")


def term_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: kept terms that a source has more of, in proportion, than its language."""
    each = terms.select("lang", F.col("term").alias("item"), F.col("n").alias("lang_n"), F.explode("profile").alias("x")).select("lang", "item", "lang_n", "x.source", "x.n")
    each = each.join(groups, ["lang", "source"])
    each = each.withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"))).withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("kept")))
    return each.where("p > q").select("lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, min_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` ranks all other sources of the language by divergence, part ``term`` the ``top_terms`` terms.

    Ranks go by value, highest first, then by the item's bytes.
    """
    counts = materialise(term_counts(docs), "term-counts")
    terms = materialise(profiles(counts, min_docs), "terms")
    groups = materialise(audited(counts, terms), "groups", light=True)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    cols = ["lang", "source", F.col("part"), "item", "value", "rank"]
    pairs = pair_values(terms, groups).withColumn("part", F.lit("pair")).withColumn("rank", rank)
    # the limit on ranks is taken in each task before its rows are shuffled
    tops = term_values(terms, groups).withColumn("part", F.lit("term")).withColumn("rank", rank).where(F.col("rank") <= top_terms)
    return pairs.select(*cols).unionByName(tops.select(*cols))

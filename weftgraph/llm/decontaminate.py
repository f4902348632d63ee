"""Benchmark decontamination by SimHash windows and multi-index Hamming search.

For an item of m words every window of m words of a document is a candidate. Windows are fingerprinted (64 bits, weighted five-word shingles)
and looked up among the items of their size: the bits are cut into four blocks of 16, and a fingerprint within ``radius`` of an item's
differs from it by few bits in at least one of them (the radius, less three, dealt out over the blocks), so the keys within that
distance of each block find all such items and few others. Each candidate is then verified by the exact weighted Jaccard
similarity of window and item, weights being ``1 + ln(items / items with the shingle)`` times multiplicity, in whole steps of 2^-20.

Before a window is fingerprinted its shingles that some item has must weigh at least ``similarity`` of the window: no window without that can be
similar to an item, so nothing is lost, and clean text costs a few prefix sums for each item size. Every document is read whole.

Items are broadcast in blocks of at most ``block_items`` items and ``block_chars`` characters. Where there are several blocks, a bitmap of fixed size over the
shingles of all items first picks the documents that can match any (again without loss), and only these are read once for each block. Weights are those
of the whole benchmark in every block: items and holders are counted once in Spark. A shingle that one item holds weighs as much as an unknown
one, so only those that two or more items hold are broadcast, at 16 bytes each; that table alone grows with the benchmark.

Words are separated by anything that is ASCII and not a letter or digit, and ASCII capitals are folded. Defined results: null or empty
texts and items, and items of fewer than ``k`` words, match nothing; a document shorter than an item is one window; of several
windows of a document that match an item the most similar is given, then the first; repeated rows are reported once each; texts of any length are
searched whole, a long one being a slice of its own; empty tables give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import materialise
from .textcore import frugal

#: Steps in which weights are counted, so that sums are exact.
UNIT = 1 << 20
#: Bits of the bitmap over the shingles of all items.
BITMAP = 27
#: Positions whose fingerprint sums are held at once, and (window, key) pairs looked up at once.
SPAN = 1 << 14
PROBES = 1 << 21


class Weights:
    """``1 + ln(items / items with the shingle)`` over the whole benchmark in units; ``keys`` (sorted) are the shingles of two or more items."""

    def __init__(self, n_items: int, keys, holders):
        import numpy as np

        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = np.rint((1 + np.log(n_items / holders[order])) * UNIT).astype(np.int64)
        self.top = round((1 + math.log(max(1, n_items))) * UNIT)

    def of(self, h):
        """Weights of an array of shingles."""
        import numpy as np

        out = np.full(len(h), self.top, np.int64)
        if len(self.keys) and len(h):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            known = self.keys[at] == h
            out[known] = self.values[at[known]]
        return out


def _shingles(texts, k: int):
    """Shingles of an Arrow column of texts, their rows, the index of each row's first, and the rows' numbers of words."""
    import numpy as np

    from . import textcore as tc

    raw, off, _ = tc.buffers(texts)
    start, end, first = tc.words(raw, off, tc.LOOSE)
    h, row = tc.shingles(tc.word_hashes(raw, start, end), first, k, short_whole=False)
    return h, row, np.searchsorted(row, np.arange(len(off))), np.diff(first)


def count_weights(items: DataFrame, k: int) -> Weights:
    """Weights of all shingles of the benchmark, counted once over all its items."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from . import textcore as tc

        for batch in batches:
            for part in tc.slices(batch, "text"):
                h, row, _, _ = _shingles(part.column(0), k)
                h, _ = tc.distinct_per_doc(h, row)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["x"])

    shared = items.select("text").mapInArrow(frugal(run), "x long").groupBy("x").agg(F.count("*").alias("n")).where("n > 1").toArrow()
    keys, holders = (shared.column(c).to_numpy().astype(np.int64) for c in range(2))
    return Weights(items.count(), keys.view(np.uint64), holders)


def shares(radius: int, blocks: int = 4) -> list[int]:
    """How far a block may differ: fingerprints that exceed every share differ in more than ``radius`` bits."""
    room = radius - blocks + 1
    return [room // blocks + (i < room % blocks) for i in range(blocks)]


def flips(bits: int, most: int):
    """All keys of so many bits with at most so many ones."""
    import numpy as np

    keys = np.arange(1 << bits, dtype=np.uint16)
    return keys[np.bitwise_count(keys) <= most]


class Items:
    """Shingles, fingerprints and block tables of a set of items; ``weights`` are those of the set itself unless given."""

    def __init__(self, rows: list[tuple[int, str]], k: int, radius: int, weights: Weights | None = None):
        import numpy as np
        import pyarrow as pa

        self.k, self.radius = k, radius
        h, row, begin, n_words = _shingles(pa.array([t or "" for _, t in rows], pa.large_string()), k)
        self.ids = [i for i, _ in rows]
        self.h = [h[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]
        if weights is None:
            keys, holders = np.unique(np.concatenate([np.empty(0, np.uint64), *map(np.unique, self.h)]), return_counts=True)
            weights = Weights(len(rows), keys[holders > 1], holders[holders > 1])
        self.weights = weights
        self.known = np.unique(h)
        self.bags: dict[int, Counter] = {}
        total = weights.of(h)
        self.prints = np.zeros(len(rows), np.uint64)
        for r in np.flatnonzero(np.diff(begin)).tolist():
            a, b = begin[r], begin[r + 1]
            self.prints[r] = self.fingerprints(h[a:b], total[a:b], np.array([0]), np.array([b - a]))[0]
        live = np.flatnonzero(np.diff(begin))
        self.sizes: dict[int, np.ndarray] = {int(m): live[n_words[live] == m] for m in np.unique(n_words[live])}
        self.shares = shares(radius)
        self.masks = [flips(16, t) if t >= 0 else np.empty(0, np.uint16) for t in self.shares]
        self.tables = {}
        for m, own in self.sizes.items():
            for b in range(4):
                part = self.block(self.prints[own], b)
                order = np.argsort(part, kind="stable")
                self.tables[m, b] = (part[order], own[order])

    @staticmethod
    def block(prints, b: int):
        import numpy as np

        return ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint16)

    @staticmethod
    def fingerprints(h, weight, at, length):
        """Fingerprints of the windows ``h[at:at + length]``: the sign of each bit's weighted votes."""
        import numpy as np

        out = np.zeros(len(at), np.uint64)
        order = np.argsort(at, kind="stable")
        low, high = at[order], np.maximum.accumulate(at[order] + length[order])
        # windows that overlap share their prefix sums, up to a span of positions
        part = np.cumsum(np.concatenate([[False], (low[1:] >= high[:-1]) | (low[1:] // SPAN != low[:-1] // SPAN)])) if len(at) else np.empty(0, np.int64)
        for own in np.split(order, np.flatnonzero(np.diff(part)) + 1) if len(at) else ():
            a, z = int(at[own].min()), int((at[own] + length[own]).max())
            votes = ((h[a:z, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int64) * 2 - 1
            sums = np.zeros((z - a + 1, 64), np.int64)
            np.cumsum(votes * weight[a:z, None], axis=0, out=sums[1:])
            ahead = sums[at[own] + length[own] - a] > sums[at[own] - a]
            out[own] = np.packbits(ahead, axis=1, bitorder="little").view(np.uint64)[:, 0]
        return out

    def near(self, prints, size: int):
        """(window, item) pairs of the items of that size whose fingerprint is within the radius of a window's."""
        import numpy as np

        none = np.empty(0, np.int64)
        own = self.sizes.get(size)
        if own is None or not len(prints):
            return none, none
        found = []
        for b, (share, masks) in enumerate(zip(self.shares, self.masks, strict=True)):
            if share < 0:
                continue
            values, items = self.tables[size, b]
            keys = self.block(prints, b)
            if len(values) <= len(masks):  # fewer items than keys: hold each item's block against the keys' distance instead
                w, i = np.nonzero(np.bitwise_count(keys[:, None] ^ values[None, :]) <= share)
                found.append(w * len(self.prints) + items[i])
                continue
            for s in range(0, len(keys), max(1, PROBES // len(masks))):
                probe = keys[s : s + max(1, PROBES // len(masks)), None] ^ masks[None, :]
                a, z = np.searchsorted(values, probe, side="left"), np.searchsorted(values, probe, side="right")
                w, m = np.nonzero(z > a)
                n = (z - a)[w, m]
                place = np.repeat(a[w, m] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                found.append(np.repeat(w + s, n) * len(self.prints) + items[place])
        pairs = np.unique(np.concatenate(found)) if found else none
        w, i = pairs // len(self.prints), pairs % len(self.prints)
        ok = np.bitwise_count(prints[w] ^ self.prints[i]) <= self.radius
        return w[ok], i[ok]

    def similarity(self, window, r: int) -> float:
        """Weighted Jaccard similarity of a window's shingles and an item."""
        import numpy as np

        bag, item = Counter(window.tolist()), self.bags.get(r)
        if item is None:
            item = self.bags[r] = Counter(self.h[r].tolist())
        either = list(bag.keys() | item.keys())
        low = high = 0
        for x, w in zip(either, self.weights.of(np.array(either, np.uint64)).tolist(), strict=True):
            a, b = bag.get(x, 0), item.get(x, 0)
            low += w * min(a, b)
            high += w * max(a, b)
        return low / high if high else 0.0

    def windows(self, h, row, begin, similarity: float):
        """(first shingle, number of shingles, item size) of the windows of every size that items may be similar to."""
        import numpy as np

        if not len(h) or not len(self.known):
            return []
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        known = self.known[at] == h
        busy = np.zeros(len(begin) - 1, bool)
        busy[row[known]] = True
        place = np.flatnonzero(busy[row])
        if not len(place):
            return []
        weight = self.weights.of(h[place])
        own, total = np.zeros(len(place) + 1, np.int64), np.zeros(len(place) + 1, np.int64)
        np.cumsum(np.where(known[place], weight, 0), out=own[1:])
        np.cumsum(weight, out=total[1:])
        r = row[place]
        first = np.searchsorted(r, np.flatnonzero(busy))
        n = np.diff(np.append(first, len(place)))
        out = []
        for m in self.sizes:
            length = m - self.k + 1
            p = np.arange(len(place) - length + 1) if len(place) >= length else np.empty(0, np.int64)
            p = p[r[p] == r[p + length - 1]]
            short = np.flatnonzero(n < length)  # whole documents
            p, size = np.concatenate([p, first[short]]), np.concatenate([np.full(len(p), length), n[short]])
            ok = own[p + size] - own[p] >= similarity * (total[p + size] - total[p])
            if ok.any():
                out.append((place[p[ok]], size[ok], m))
        return out


def _pass(docs: DataFrame, items: Items, similarity: float) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("item_id", T.LongType()),
            T.StructField("start_word", T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("hamming", T.IntegerType()),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from . import textcore as tc

        it = shared.value
        for batch in batches:
            key_type = batch.schema.field("doc_id").type
            for part in tc.slices(batch, "text"):
                h, row, begin, _ = _shingles(part.column(1), it.k)
                best: dict[tuple[int, int], tuple] = {}
                found = it.windows(h, row, begin, similarity)
                if not found:
                    continue
                starts, lengths = (np.concatenate([x[c] for x in found]) for c in (0, 1))
                every = it.fingerprints(h, it.weights.of(h), starts, lengths)
                for (at, length, m), prints in zip(found, np.split(every, np.cumsum([len(x[0]) for x in found])[:-1]), strict=True):
                    for w, i in zip(*(x.tolist() for x in it.near(prints, m)), strict=True):
                        a, n = int(at[w]), int(length[w])
                        sim = it.similarity(h[a : a + n], i)
                        r = int(row[a])
                        s = a - int(begin[r])
                        if sim >= similarity and (sim, -s) > best.get((r, i), (0.0, 0))[:2]:
                            best[r, i] = (sim, -s, n + it.k - 1, (int(it.prints[i]) ^ int(prints[w])).bit_count())
                if best:
                    ids = part.column(0).to_pylist()
                    out = [(ids[r], it.ids[i], -s, m, d, sim) for (r, i), (sim, s, m, d) in sorted(best.items())]
                    kinds = [key_type, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(frugal(run), schema)


def likely(docs: DataFrame, items: DataFrame, k: int, similarity: float) -> DataFrame:
    """``doc_id, text`` of the documents that any item may be similar to, by a bitmap of fixed size over the shingles of all items.

    A window of an item's size of which a share ``t`` is known holds one of the least item's size of which ``2 t - 1`` is.
    """
    import numpy as np

    def bits(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from . import textcore as tc

        for batch in batches:
            for part in tc.slices(batch, "text"):
                h, row, begin, _ = _shingles(part.column(0), k)
                n = np.diff(begin)
                own = np.unique(h >> np.uint64(64 - BITMAP))
                word = (own >> np.uint64(6)).astype(np.int64)
                bit = (np.uint64(1) << (own & np.uint64(63))).view(np.int64)
                least = int(n[n > 0].min()) if (n > 0).any() else None
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit), pa.array([least] * len(word), pa.int64())], names=["word", "bit", "least"])

    found = items.select("text").mapInArrow(frugal(bits), "word long, bit long, least long").groupBy("word").agg(F.bit_or("bit").alias("bits"), F.min("least").alias("least"))
    rows = found.toArrow()  # at most 2^21 rows
    bitmap = np.zeros(1 << (BITMAP - 6), np.int64)
    bitmap[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    least = min(rows.column(2).to_pylist(), default=0)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from . import textcore as tc

        table = shared.value
        for batch in batches:
            for part in tc.slices(batch, "text"):
                h, row, begin, _ = _shingles(part.column(1), k)
                at = h >> np.uint64(64 - BITMAP)
                known = np.zeros(len(h) + 1, np.int64)
                np.cumsum((table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1), out=known[1:])
                keep = np.zeros(part.num_rows, bool)
                p = np.arange(max(0, len(h) - least + 1))
                p = p[row[p] == row[p + least - 1]] if len(p) else p
                keep[row[p[known[p + least] - known[p] >= (2 * similarity - 1) * least]]] = True
                n = np.diff(begin)
                keep |= (n > 0) & (n < least) & (known[begin[1:]] - known[begin[:-1]] >= similarity * n)
                if keep.any():
                    yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in part.columns], schema=part.schema)

    src = docs.select("doc_id", "text")
    return src.mapInArrow(frugal(run), src.schema)


def matches(
    docs: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = 18, block_items: int = 20_000, block_chars: int = 8 << 20
) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, hamming, similarity`` of every document and item that match."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    if size["n"] > block_items or size["chars"] > block_chars:
        docs = materialise(likely(docs, items, k, similarity), "likely")
    out, rows, held, weights = None, [], 0, count_weights(items, k)

    def add(rows):
        one = _pass(docs, Items(rows, k, radius, weights), similarity)
        return one if out is None else out.unionByName(one)

    for item, text in items.toLocalIterator():
        if rows and (len(rows) >= block_items or held + len(text) > block_chars):
            out, rows, held = add(rows), [], 0
        rows.append((item, text))
        held += len(text)
    return add(rows)


def keep_clean(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that match no item; columns unchanged. Rows with a null id stay."""
    found = materialise(matches(docs, benchmark, **params).select("doc_id"), "leaks").distinct()
    kept = docs.alias("d").join(found.alias("g"), F.expr("d.doc_id = g.doc_id"), "left_anti")
    return kept.select(*[F.col(f"d.`{c}`") for c in docs.columns])

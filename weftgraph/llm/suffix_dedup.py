"""Exact removal of repeated byte strings with two-stage suffix sorting.

A byte goes when a string of ``length`` bytes that covers it also starts anywhere else. Texts are cut so that equal
strings always meet in one block, each block is suffix-sorted, and neighbours with a common prefix of ``length`` or more
are repeats:

1. Every window of ``length`` bytes is represented by the smallest-hashed ``K``-byte string in it (its *anchor*), which depends on
   the window's bytes alone. Consecutive windows with one anchor are a *run*. Only anchors that occur twice in the corpus can hold
   repeats, so anchors are counted first, at some 20 bytes for each 80 bytes of text; runs with a unique anchor are done.
2. Identical texts are one text with a number of copies. The runs left are cut out with the ``length - 1`` bytes that their last
   window needs and dealt out by anchor.
3. ``repeated_windows``: within a block of runs, suffixes smaller than their successors are sorted directly, the others are induced
   from them by one scan over the buckets of first bytes, and adjacent common prefixes are measured.
4. The repeated windows of each document are united to spans.

Runs are collapsed when their bytes are equal, so a passage that very many documents share is sorted once; what stays together are
the differing runs of one anchor. An anchor with over ``HOT_RUNS`` of them (the edges of such a passage) is not left to one block: the windows
of its runs are counted one by one by 128-bit fingerprints (``_hot_windows``), which splits at any window.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; rows with a null ``doc_id`` take no part and get
null results in ``removals`` and stay untouched in ``dedup``; repeated rows are copies of one another (so all of their windows
repeat); columns other than ``doc_id`` and ``text`` are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise, n_partitions
from .textcore import frugal, frugal_group

K = 48
UNIT_BYTES = 8 << 20
#: Runs in one row of those that are passed on.
PASSED = 1024
#: Different runs of one anchor from which it is hot.
HOT_RUNS = 50_000
#: Up to so many ids (8 bytes each) of texts that lose something are broadcast.
BROADCAST_IDS = 1_000_000
#: A longer text is scanned in pieces of this many windows.
PIECE = 512 << 10
_POS_BITS = 23


def anchor_runs(raw, off, length: int, k: int = K):
    """Runs of windows with one anchor: (row, first window, number of windows, anchor hash, hash of the run); windows count from the row's start."""
    import numpy as np

    from . import textcore as tc

    none = np.empty(0, np.int64)
    n = len(raw)
    no_hash = np.empty(0, np.uint64)
    if n < length:
        return none, none, none, no_hash, no_hash
    fwd, inv = tc._powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(tc._TABLE[False][raw] * fwd[:n], out=sums[1:])
    h = tc.mix((sums[k:] - sums[:-k]) * inv[: n - k + 1])
    w = length - k + 1
    key = (h & ~np.uint64((1 << _POS_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
    m = len(key)
    pad = -m % w
    block = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    left = np.minimum.accumulate(block, axis=1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(right[: m - w + 1], left[w - 1 : m])  # of windows 0 .. n - length
    at = (low & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(at)]
    inside = np.arange(len(at)) + length <= off[row + 1]
    pick = np.flatnonzero(inside)
    if not len(pick):
        return none, none, none, no_hash, no_hash
    at, row = at[pick], row[pick]
    new = np.ones(len(pick), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(pick)))
    begin = pick[first]
    whole = tc.mix((sums[begin + count + length - 1] - sums[begin]) * inv[begin])
    return row[first], begin - off[row[first]], count, h[at[first]], whole


def _pieces(batches: Iterator, length: int) -> Iterator:
    """(ids, base offsets, bytes, offsets) of slices; very long texts in overlapping pieces."""
    import numpy as np

    from . import textcore as tc

    for batch in batches:
        for part in tc.slices(batch, "text"):
            raw, off, _ = tc.buffers(part.column(1))
            ids = part.column(0).to_pylist()
            if len(raw) <= PIECE + length:
                yield ids, np.zeros(len(ids), np.int64), raw, off
                continue
            for i, one in enumerate(ids):
                text = raw[off[i] : off[i + 1]]
                for s in range(0, max(1, len(text)), PIECE):
                    cut = text[s : s + PIECE + length - 1]
                    yield [one], np.array([s], np.int64), cut, np.array([0, len(cut)], np.int64)


def _scatter(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Anchors, bucketed by hash. Within a unit an anchor that occurs twice is known to repeat: its runs are passed on
    (bucket -1 - n) and the bucket only learns that it is there."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .textcore import mix as tc_mix

        def flush(cols):
            ids, start, count, h, whole = (np.concatenate(c) for c in cols)
            uniq, inv, seen = np.unique(h, return_inverse=True, return_counts=True)
            known = seen[inv] > 1
            # equal runs are collapsed before they meet in a block, so only different ones count there
            different = np.bincount(inv[np.unique(tc_mix(h + tc_mix(whole)), return_index=True)[1]], minlength=len(uniq))
            # anchors are the smallest hashes around, so their own high bits are all but zero
            bucket = ((tc_mix(uniq) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            out = []
            if known.any():
                pass_by = np.flatnonzero(known)
                for at in range(0, len(pass_by), PASSED):  # small rows, spread evenly
                    w = pass_by[at : at + PASSED]
                    spread = -1 - int(tc_mix(h[w[:1]] + np.uint64(at))[0] % np.uint64(buckets))
                    out.append((spread, ids[w].tobytes(), start[w].tobytes(), count[w].tobytes(), h[w].tobytes()))
            order = np.argsort(bucket[inv], kind="stable")
            first = np.zeros(len(h), bool)
            first[np.unique(inv, return_index=True)[1]] = True
            order = order[first[order]]
            where = bucket[inv][order]
            # a notice of a known anchor has no windows of its own but, negative, the number of its different runs
            size = np.where(known, -np.minimum(different[inv], 32000), count)[order].astype(np.int16)
            ids, start, h = ids[order], start[order], h[order]
            cut = np.flatnonzero(np.diff(where, prepend=where[:1] + np.uint64(1)))
            for a, b in zip(cut, [*cut[1:], len(where)], strict=True):
                out.append((int(where[a]), ids[a:b].tobytes(), start[a:b].tobytes(), size[a:b].tobytes(), h[a:b].tobytes()))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), *[pa.binary()] * 4], strict=True)],
                names=["bucket", "ids", "start", "size", "h"],
            )

        cols, held = [[], [], [], [], []], 0
        for ids, base, raw, off in _pieces(batches, length):
            row, start, count, h, whole = anchor_runs(raw, off, length)
            if len(row):
                for c, v in zip(cols, (np.asarray(ids, np.int64)[row], (start + base[row]).astype(np.int64), count.astype(np.int16), h, whole), strict=True):
                    c.append(v)
            held += len(raw)
            if held > UNIT_BYTES and cols[0]:
                yield flush(cols)
                cols, held = [[], [], [], [], []], 0
        if cols[0]:
            yield flush(cols)

    return docs.mapInArrow(frugal(run), "bucket long, ids binary, start binary, size binary, h binary")


def _candidates(scattered: DataFrame, hot_runs: int) -> DataFrame:
    """``doc_id, runs, hot``: packed (first window, windows, anchor) of the runs whose anchor occurs again; in rows of their own the hot anchors."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        def cat(name, kind, which):
            return np.frombuffer(b"".join(which[name]), kind)

        bucket = table["bucket"].to_pylist()
        cols = {c: table[c].to_pylist() for c in ("ids", "start", "size", "h")}
        own = [i for i, b in enumerate(bucket) if b >= 0]
        passed = [i for i, b in enumerate(bucket) if b < 0]
        take = lambda which: {c: [cols[c][i] for i in which] for c in cols}
        parts, hot = [], np.empty(0, np.int64)
        if own:
            t = take(own)
            h, size = cat("h", "<u8", t), cat("size", "<i2", t)
            uniq, inv = np.unique(h, return_inverse=True)
            total = np.bincount(inv, weights=np.maximum(-size.astype(np.int64), 1))
            keep = (total[inv] > 1) & (size > 0)
            hot = uniq[total > hot_runs].view(np.int64)
            parts.append((cat("ids", "<i8", t)[keep], cat("start", "<i8", t)[keep], size[keep], h[keep]))
        if passed:
            t = take(passed)
            parts.append((cat("ids", "<i8", t), cat("start", "<i8", t), cat("size", "<i2", t), cat("h", "<u8", t)))
        ids, start, size, h = (np.concatenate([p[i] for p in parts]) for i in range(4)) if parts else [np.empty(0, np.int64)] * 4
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        rec = np.zeros(len(ids), [("start", "<i8"), ("h", "<u8"), ("size", "<i2")])
        rec["start"], rec["h"], rec["size"] = start[order], h[order], size[order]
        cut = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1)) if len(ids) else np.empty(0, np.int64)
        ends = [*cut[1:], len(ids)] if len(cut) else []
        docs = [*ids[cut].tolist(), *[None] * len(hot)]
        blobs = [*(rec[a:b].tobytes() for a, b in zip(cut, ends, strict=True)), *[None] * len(hot)]
        flags = [*[None] * len(cut), *hot.tolist()]
        return pa.table([pa.array(docs, pa.int64()), pa.array(blobs, pa.binary()), pa.array(flags, pa.int64())], names=["doc_id", "runs", "hot"])

    return scattered.groupBy("bucket").applyInArrow(frugal_group(run), "doc_id long, runs binary, hot long")


def window_prints(raw, count: int, length: int):
    """128-bit fingerprints, as two signed columns, of the first ``count`` windows of a byte array."""
    import numpy as np

    from . import textcore as tc

    fwd, inv = tc._powers(len(raw) + 1)
    out = []
    for table in (tc._TABLE[False], tc.SECOND_TABLE):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(table[raw] * fwd[: len(raw)], out=sums[1:])
        out.append(tc.mix((sums[length : length + count] - sums[:count]) * inv[:count]).view(np.int64))
    return out


def _hot_windows(cand: DataFrame, hot: list[int], length: int) -> DataFrame:
    """``doc_id, a, b``: repeated windows of runs with a hot anchor, by counting fingerprints of single windows.

    Equal runs of a batch repeat for certain and are counted once, with their copies. Keys are as many as different windows, copies are
    summed before the shuffle, and the join back can be split anywhere.
    """
    known = cand.sparkSession.sparkContext.broadcast(frozenset(h & 0xFFFFFFFFFFFFFFFF for h in hot))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .textcore import slices

        kind = [("start", "<i8"), ("h", "<u8"), ("size", "<i2")]
        names = ["one", "two", "doc_id", "a", "b", "copies"]
        for batch in (part for whole in batches for part in slices(whole, "text", 4 << 20)):
            seen: dict[bytes, list] = {}
            for doc, text, runs, copies in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for start, h, size in np.frombuffer(b"".join(runs), kind).tolist():
                    if h in known.value:
                        seen.setdefault(text[start : start + size + length - 1], []).append((doc, start, size, copies))
            rest = [(None, None, d, s, s + n, 2) for refs in seen.values() for d, s, n, _ in refs[1:]]
            if rest:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rest, strict=True)], names=names)
            for cut, refs in seen.items():
                doc, start, size, _ = refs[0]
                one, two = window_prints(np.frombuffer(cut, np.uint8), size, length)
                at = np.arange(start, start + size)
                full = lambda v: pa.array(np.full(size, v, np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), full(doc), pa.array(at), pa.array(at + 1), full(sum(r[3] for r in refs))], names=names)

    rows = materialise(cand.select("doc_id", "text", "runs", "copies").mapInArrow(frugal(run), "one long, two long, doc_id long, a long, b long, copies long"), "hot-windows")
    again = rows.where("one is not null").groupBy("one", "two").agg(F.sum("copies").alias("n")).where("n > 1").select("one", "two")
    cols = ["doc_id", "a", "b"]
    return rows.join(again, ["one", "two"], "left_semi").select(*cols).unionByName(rows.where("one is null").select(*cols))


def _segments(cand: DataFrame, length: int, hot: list[int]) -> DataFrame:
    """``h, doc_id, start, windows, copies, bytes`` of each candidate run.

    Runs with the same bytes within a batch repeat for certain: one of them goes to the block of its anchor, counted as copies, and
    the others pass by it (without bytes). A passage in very many documents is so collapsed before it is shuffled.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .textcore import slices

        kind = [("start", "<i8"), ("h", "<u8"), ("size", "<i2")]
        skip = frozenset(h & 0xFFFFFFFFFFFFFFFF for h in hot)
        names = ["h", "doc_id", "start", "windows", "copies", "bytes"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

        def made(seen):
            rows = []
            for (h, cut), refs in seen.items():
                copies = sum(r[3] for r in refs)
                rows.append((h, *refs[0][:3], copies, cut))
                rows.extend((doc * 0x9E3779B1 + start & 0x7FFFFFFF, doc, start, size, 2, None) for doc, start, size, _ in refs[1:])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        seen: dict[tuple[int, bytes], list] = {}
        held = 0
        for batch in (part for whole in batches for part in slices(whole, "text")):
            for doc, text, runs, copies in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for start, h, size in np.frombuffer(b"".join(runs), kind).tolist():
                    if h in skip:
                        continue
                    cut = text[start : start + size + length - 1]
                    key = (h - (1 << 64) if h >> 63 else h, cut)
                    if key not in seen:
                        seen[key] = []
                        held += len(cut)
                    seen[key].append((doc, start, size, copies))
                    held += 64
                if held > 8 << 20:
                    yield made(seen)
                    seen, held = {}, 0
        if seen:
            yield made(seen)

    return cand.select("doc_id", "text", "runs", "copies").mapInArrow(frugal(run), "h long, doc_id long, start long, windows int, copies long, bytes binary")


def two_stage_order(text, ends, live):
    """Suffix order of the positions marked ``live``.

    ``text``: bytes of all segments, ``ends``: for each position the end of its segment. A segment's end sorts before any byte, equal
    suffixes of different segments in any order. ``live`` must be closed: with a suffix larger than its successor it holds that successor, if
    it is in the segment.
    """
    import numpy as np

    n = len(text)
    nxt = np.full(n, -1, np.int16)
    nxt[:-1] = text[1:]
    nxt[ends - 1] = -1
    differs = nxt != text
    idx = np.where(differs, np.arange(n, dtype=np.int32), np.int32(n))
    idx = np.minimum.accumulate(idx[::-1])[::-1]
    smaller = (nxt > text)[idx]  # smaller than its successor
    del idx, differs, nxt
    # stage one: sort those directly, eight bytes at a time; only ties go on
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = text
    word = np.zeros(n, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | wide[i : i + n]

    def load(pos, depth):
        at = pos + depth
        left = np.clip(ends[pos] - at, 0, 8)
        got = word[np.minimum(at, n - 1)]
        keep = (np.uint64(64) - (left * 8).astype(np.uint64)) % np.uint64(64)
        got = np.where(left == 8, got, (got >> keep) << keep)
        return np.where(left == 0, np.uint64(0), got), left

    pos = np.flatnonzero(smaller & live)
    order = np.empty(0, np.int64)
    if len(pos):
        key, left = load(pos, 0)
        o = np.argsort(key, kind="stable")
        order, key = pos[o], key[o]
        left = left[o]
        same = np.zeros(len(order), bool)
        same[1:] = key[1:] == key[:-1]
        # a zero byte and a segment's end give equal words: then this word is looked at again, with the bytes left
        depth = -8 if (same[1:] & (left[1:] != left[:-1])).any() else 0
        tied = same.copy()
        tied[:-1] |= same[1:]
        group = np.cumsum(~same) - 1
        active = np.flatnonzero(tied)
        while len(active):
            depth += 8
            p, g = order[active], group[active]
            key, left = load(p, depth)
            o = np.lexsort((left, key, g))
            p, g, key, left = p[o], g[o], key[o], left[o]
            order[active] = p
            same = np.zeros(len(p), bool)
            same[1:] = (g[1:] == g[:-1]) & (key[1:] == key[:-1]) & (left[1:] == left[:-1])
            open_ = same & (left == 8)
            tied = open_.copy()
            tied[:-1] |= open_[1:]
            fresh = np.cumsum(~same)
            group[active] = fresh
            active = active[tied]
    # stage two: scan the buckets of first bytes and put each larger suffix before whose successor it meets
    first = text[order]
    cut = np.searchsorted(first, np.arange(257))
    waiting: list[list] = [[] for _ in range(256)]

    def hand_on(found, c):
        prev = found - 1
        ok = prev >= 0
        prev, found = prev[ok], found[ok]
        ok = (ends[prev] == ends[found]) & live[prev] & ~smaller[prev]
        prev = prev[ok]
        byte = text[prev]
        here = prev[byte == c]
        later = byte > c
        prev, byte = prev[later], byte[later]
        if len(prev):
            o = np.argsort(byte, kind="stable")
            prev, byte = prev[o], byte[o]
            at = np.flatnonzero(np.diff(byte.astype(np.int16), prepend=-1))
            for a, b in zip(at, [*at[1:], len(prev)], strict=True):
                waiting[byte[a]].append(prev[a:b])
        return here

    last = np.unique(ends) - 1
    last = last[live[last]]
    o = np.argsort(text[last], kind="stable")
    for p in np.split(last[o], np.flatnonzero(np.diff(text[last[o]])) + 1) if len(last) else ():
        waiting[text[p[0]]].append(p)
    out = []
    for c in range(256):
        induced = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        waiting[c] = []
        while len(induced):
            out.append(induced)
            induced = hand_on(induced, c)
        direct = order[cut[c] : cut[c + 1]]
        if len(direct):
            out.append(direct)
            hand_on(direct, c)
    return (np.concatenate(out) if out else np.empty(0, np.int64)), word


def repeated_windows(segments: list[bytes], windows: list[int], length: int) -> list:
    """For each distinct segment a boolean array: which of its windows also start elsewhere in the segments."""
    import numpy as np

    sizes = np.array([len(s) for s in segments], np.int64)
    text = np.frombuffer(b"".join(segments), np.uint8)
    stop = np.cumsum(sizes)
    start = stop - sizes
    ends = np.repeat(stop.astype(np.int32), sizes)
    n = len(text)
    counts = np.asarray(windows, np.int64)
    window = np.arange(n) - np.repeat(start, sizes) < np.repeat(counts, sizes)
    # beyond the last window a suffix is needed only as the successor of a larger one
    nxt = np.full(n, -1, np.int16)
    nxt[:-1] = text[1:]
    nxt[ends - 1] = -1
    idx = np.where(nxt != text, np.arange(n, dtype=np.int32), np.int32(n))
    idx = np.minimum.accumulate(idx[::-1])[::-1]
    smaller = (nxt > text)[idx]
    stops = np.where(smaller, np.arange(n, dtype=np.int32), np.int32(n))
    stops = np.minimum.accumulate(stops[::-1])[::-1]
    final = start + counts - 1
    close = np.minimum(stops[final], stop - 1)
    live = np.arange(n) <= np.repeat(close, sizes)
    order, word = two_stage_order(text, ends, live)
    order = order[window[order]]
    hit = np.zeros(n, bool)
    pair = np.arange(1, len(order))
    for depth in range(0, length, 8):  # common prefixes of neighbours, eight bytes at a time
        at = depth if depth + 8 <= length else length - 8
        pair = pair[word[order[pair] + at] == word[order[pair - 1] + at]]
        if not len(pair):
            break
    hit[order[pair]] = True
    hit[order[pair - 1]] = True
    return [hit[a : a + c] for a, c in zip(start.tolist(), counts.tolist(), strict=True)]


def _solve(segments: DataFrame, length: int, cells: int, limit: int = 1 << 20) -> DataFrame:
    """``doc_id, a, b``: windows a..b-1 of a document repeat."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        doc, begin, wins, copies = (table[c].to_numpy() for c in ("doc_id", "start", "windows", "copies"))
        key = table["h"].to_numpy()
        data = table["bytes"].to_pylist()
        passed = [i for i, x in enumerate(data) if x is None]
        docs, froms = doc[passed].tolist(), begin[passed].tolist()
        tos = (begin[passed] + wins[passed]).tolist()
        order = np.argsort(key, kind="stable")

        def settle(which):
            place: dict[bytes, int] = {}
            refs: list[list[int]] = []
            for i in which:
                at = place.setdefault(data[i], len(refs))
                if at == len(refs):
                    refs.append([])
                refs[at].append(i)
            segs = list(place)
            found = repeated_windows(segs, [len(s) - length + 1 for s in segs], length)
            for own, hit in zip(refs, found, strict=True):
                if len(own) > 1 or copies[own[0]] > 1:
                    hit = np.ones(len(hit), bool)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                for i in own:
                    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                        docs.append(int(doc[i]))
                        froms.append(int(begin[i]) + a)
                        tos.append(int(begin[i]) + b)

        block, held, last = [], 0, None
        for i in order.tolist():
            if data[i] is None:
                continue
            if held > limit and key[i] != last:
                settle(block)
                block, held = [], 0
            block.append(i)
            held += len(data[i])
            last = key[i]
        if block:
            settle(block)
        return pa.table([pa.array(docs, pa.int64()), pa.array(froms, pa.int64()), pa.array(tos, pa.int64())], names=["doc_id", "a", "b"])

    return segments.withColumn("cell", F.pmod("h", F.lit(cells))).groupBy("cell").applyInArrow(frugal_group(run), "doc_id long, a long, b long")


_RESULT = "doc_id long, n_removed long, n_spans long, kept_sha256 string, kept string, spans array<struct<from:long,to:long>>"


def _apply(cand: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import numpy as np
        import pyarrow as pa

        from .textcore import slices

        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        for batch in (part for whole in batches for part in slices(whole, "text")):
            rows = []
            for doc, text, pairs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                iv = np.array([(p["a"], p["b"] + length - 1) for p in pairs], np.int64).reshape(-1, 2)
                iv = iv[np.argsort(iv[:, 0])]
                reach = np.maximum.accumulate(iv[:, 1])
                new = np.flatnonzero(np.concatenate([[True], iv[1:, 0] > reach[:-1]]))
                a, b = iv[new, 0].tolist(), reach[np.append(new[1:], len(iv)) - 1].tolist()
                kept = b"".join(text[s:e] for s, e in zip([0, *b], [*a, len(text)], strict=True))
                rows.append((doc, len(text) - len(kept), len(a), sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"), [{"from": s, "to": e} for s, e in zip(a, b, strict=True)]))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), kind], strict=True)],
                    names=["doc_id", "n_removed", "n_spans", "kept_sha256", "kept", "spans"],
                )

    return cand.select("doc_id", "text", "pairs").mapInArrow(frugal(run), _RESULT)


def _changed(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(all rows: ``doc_id, rep, n_bytes, sha``; representatives that lose bytes: ``doc_id, n_removed, n_spans, kept_sha256, kept, spans``)."""
    parts = n_partitions(docs.sparkSession)
    src = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    marks = materialise(src.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "marks")
    groups = materialise(marks.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "copies")
    rows = marks.join(groups.select("sha", "rep"), "sha")
    # a hot anchor has more runs than a block should hold; there are at most some hundred thousand of them, whatever the input
    hot_runs = max(HOT_RUNS, marks.count() // 10_000)
    found = materialise(_candidates(_scatter(src, length, 4 * parts), hot_runs), "runs")
    hot = [r["hot"] for r in found.where("hot is not null").select("hot").collect()]
    runs = found.where("runs is not null").groupBy("doc_id").agg(F.collect_list("runs").alias("runs"))
    reps = groups.select(F.col("rep").alias("doc_id"), "copies")
    cand = src.join(runs.join(reps, "doc_id"), "doc_id").select("doc_id", "text", "runs", "copies")
    pairs = _solve(_segments(cand, length, hot), length, 8 * parts)
    if hot:
        pairs = pairs.unionByName(_hot_windows(cand, hot, length))
    pairs = pairs.distinct()
    pairs = materialise(pairs.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("pairs")), "pairs")
    if pairs.count() <= BROADCAST_IDS:  # then only texts that lose something are shuffled; the join below holds for any number
        src = src.join(F.broadcast(pairs.select("doc_id")), "doc_id", "left_semi")
    changed = materialise(_apply(src.join(pairs, "doc_id"), length).dropDuplicates(["doc_id"]), "changed")
    return rows, changed


def removals(docs: DataFrame, length: int = 200) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of every row (spans are null where nothing goes)."""
    rows, changed = _changed(docs, length)
    found = changed.select(F.col("doc_id").alias("rep"), "n_removed", "n_spans", "kept_sha256", "spans")
    out = rows.join(found, "rep", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "spans",
    )
    nameless = docs.where("doc_id is null").select(*[F.lit(None).cast(t).alias(c) for c, t in out.dtypes])
    return out.unionByName(nameless)


def dedup(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with every repeated string cut out of ``text`` (bytes of a character that was cut apart go too) and ``n_chars`` renewed."""
    rows, changed = _changed(docs, length)
    found = rows.join(changed.select(F.col("doc_id").alias("rep"), "kept"), "rep").select("doc_id", "kept").dropDuplicates(["doc_id"])
    out = docs.alias("d").join(found.alias("f"), F.expr("cast(d.doc_id as long) = f.doc_id"), "left")
    text = F.coalesce("f.kept", "d.text")
    own = lambda c, t: text if c == "text" else F.length(text).cast(t) if c == "n_chars" else F.col(f"d.`{c}`")
    return out.select(*[own(c, t).alias(c) for c, t in docs.dtypes])

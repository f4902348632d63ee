"""Removal of word windows that an earlier document has as well, by doubling their length level by level.

A level turns what repeats at ``k`` words into what repeats at ``length = 2 k``: a window can only repeat if the shorter windows inside it do, so only those
that repeat at one length are extended to twice that length, until none is left. The first level extends to the length asked for, which settles
what is removed; the levels above it tell how long the repeated passages are.

One level:

1. Each window of ``length`` words is represented by the smallest-hashed window of ``k`` words inside it (its *anchor*), which depends on its words alone, so
   equal windows have equal anchors. Consecutive windows with one anchor are a *run*: some two for each ``k`` words. Anchors that occur in one document only
   end here, with all their windows.
2. Equal runs are one *class*, with its smallest and largest document, so copies and passages of very many documents are summed before they are shuffled. The windows of an
   anchor with one class repeat wherever the class does. Where an anchor has several (the edges of passages), the windows of each class are looked at one by
   one: their fingerprints are grouped under the anchor, 128 bits together.
3. Every occurrence of a run takes over which of its windows repeat, and in which smallest document.
4. Where more than ``length`` windows in a row repeat there is room for a window of twice the length: the hashes of the words are cut out and go to the next level.

Joins and groups are keyed by anchors, windows or documents; aggregates are partial and joins are plain, so that Spark splits what is skewed.

Defined results: a null text has no words; texts shorter than ``length`` lose nothing; a window that occurs twice in one document, or in rows of one ``doc_id`` only, is not
removed; rows with a null ``doc_id`` take no part and lose nothing; repeated rows are treated alike, and several texts under one id each for itself; columns other than
``doc_id`` and ``text`` are ignored; an empty table gives an empty result. A text is handled whole, with some hundred times its size in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import discard, materialise
from .textcore import frugal

#: Up to so many ids (12 bytes each) of texts that are needed again are broadcast; beyond it the texts meet their ids in a plain join.
BROADCAST_IDS = 1_000_000
_KEY = ["doc_id", "unit"]


def word_column(col):
    """(word hashes, offsets of the rows) of a column of texts, or of packed hashes."""
    import numpy as np
    import pyarrow as pa

    from . import textcore as tc

    raw, off, _ = tc.buffers(col)
    if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type):
        return np.frombuffer(raw.tobytes(), np.uint64), off // 8
    start, end, first = tc.words(raw, off)
    return tc.word_hashes(raw, start, end, lower=False), first


class Windows:
    """Hashes of any window of words, from running sums."""

    def __init__(self, hashes):
        import numpy as np

        from . import textcore as tc

        n = len(hashes)
        fwd, self.inv = tc._powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * fwd[:n], out=self.sums[1:])
        self.mix = tc.mix

    def at(self, start, size):
        return self.mix((self.sums[start + size] - self.sums[start]) * self.inv[start])


def anchored(windows: Windows, first, length: int, k: int):
    """Runs of windows of ``length`` words with one anchor of ``k``: (row, first window, windows, anchor, hash of the run), windows counted from the row's start."""
    import numpy as np

    n = int(first[-1])
    if n < length:
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    h = windows.at(np.arange(n - k + 1), k)
    w = length - k + 1
    low = np.uint64(0xFFFFFFFF)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    block = np.concatenate([key, np.full(-len(key) % w, ~np.uint64(0))]).reshape(-1, w)
    left = np.minimum.accumulate(block, axis=1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(right[: n - length + 1], left[w - 1 : n - k + 1]) & low).astype(np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(at)]
    pick = np.flatnonzero(np.arange(len(at)) + length <= first[row + 1])
    at, row = at[pick], row[pick]
    new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    count = np.diff(np.append(new, len(pick)))
    begin = pick[new]
    return row[new], begin - first[row[new]], count, h[at[new]].view(np.int64), windows.at(begin, count + length - 1).view(np.int64)


def _runs(segs: DataFrame, length: int, k: int) -> DataFrame:
    """``anchor, run, doc_id, unit, start, windows``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from . import textcore as tc

        for part in (part for batch in batches for part in tc.slices(batch, "body")):
            hashes, first = word_column(part.column(3))
            row, start, count, anchor, whole = anchored(Windows(hashes), first, length, k)
            at = pa.array(row)
            base = part.column(2).to_numpy()[row] if len(row) else start
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(whole), part.column(0).take(at), part.column(1).take(at), pa.array(base + start), pa.array(count.astype("i4"))],
                names=["anchor", "run", "doc_id", "unit", "start", "windows"],
            )

    return segs.select(*_KEY, "start", "body").mapInArrow(frugal(run), "anchor long, run long, doc_id long, unit int, start long, windows int")


def _with_body(ids: DataFrame, segs: DataFrame) -> DataFrame:
    """Bodies joined to ``ids`` (materialised, one row a document)."""
    if segs.schema["body"].dataType.typeName() == "string" and ids.count() <= BROADCAST_IDS:  # whole texts; pieces are what is needed already
        segs = segs.join(F.broadcast(ids.select(*_KEY)), _KEY, "left_semi")
    return segs.join(ids, _KEY)


def _prints(needed: DataFrame, length: int) -> DataFrame:
    """``anchor, run, at, print, lo, hi``: the windows of each class, read in its smallest document."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from . import textcore as tc

        for part in (part for batch in batches for part in tc.slices(batch, "body")):
            hashes, first = word_column(part.column(2))
            windows = Windows(hashes)
            doc, base = part.column(0).to_numpy(), part.column(1).to_numpy()
            lists = part.column(3)
            row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            start, count, anchor, whole, hi = (f.to_numpy(zero_copy_only=False) for f in lists.flatten().flatten())
            begin = start - base[row] + first[row]
            here = np.flatnonzero((start >= base[row]) & (begin + count + length - 1 <= first[row + 1]))  # runs of other pieces of the document are read there
            count = count[here].astype(np.int64)
            own = np.repeat(here, count)
            at = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[own]), pa.array(whole[own]), pa.array(at.astype("i4")), pa.array(windows.at(begin[own] + at, length).view(np.int64)), pa.array(doc[row[own]]), pa.array(hi[own])],
                names=["anchor", "run", "at", "print", "lo", "hi"],
            )

    return needed.select("doc_id", "start", "body", "runs").mapInArrow(frugal(run), "anchor long, run long, at int, print long, lo long, hi long")


def extend(segs: DataFrame, length: int, k: int) -> DataFrame | None:
    """``doc_id, unit, found``: for each document the windows ``from <= i < to`` of ``length`` words that two documents have; ``gone`` where one of them is smaller. None if there are none."""
    runs = _runs(segs, length, k)
    shared = runs.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    cand = materialise(runs.join(shared, "anchor", "left_semi"), f"runs-{length}")
    first = F.min(F.struct("doc_id", "unit", "start", "windows")).alias("rep")
    classes = materialise(cand.groupBy("anchor", "run").agg(first, F.max("doc_id").alias("hi")), f"classes-{length}")
    if classes.isEmpty():
        return None
    several = classes.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    alone = classes.join(several, "anchor", "left_anti").where("rep.doc_id < hi")
    masks = alone.select("anchor", "run", F.lit(0).alias("a"), F.col("rep.windows").alias("b"), F.col("rep.doc_id").alias("lo"))
    many = classes.join(several, "anchor", "left_semi").select("rep.*", "anchor", "run", "hi")
    needed = many.groupBy(*_KEY).agg(F.collect_list(F.struct("start", "windows", "anchor", "run", "hi")).alias("runs"))
    whole = segs.schema["body"].dataType.typeName() == "string"
    needed = materialise(needed, f"edges-{length}") if whole else needed
    prints = materialise(_prints(_with_body(needed, segs), length), f"prints-{length}")
    best = prints.groupBy("anchor", "print").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("anchor", "print", "lo")
    along = Window.partitionBy("anchor", "run").orderBy("at")  # at most k + 1 windows
    told = prints.select("anchor", "run", "at", "print").distinct().join(best, ["anchor", "print"]).select("anchor", "run", "at", "lo")
    told = told.withColumn("new", F.coalesce((F.col("at") != F.lag("at").over(along) + 1) | (F.col("lo") != F.lag("lo").over(along)), F.lit(True)).cast("int"))
    told = told.withColumn("island", F.sum("new").over(along)).groupBy("anchor", "run", "island").agg(F.min("at").alias("a"), (F.max("at") + 1).alias("b"), F.min("lo").alias("lo"))
    masks = masks.unionByName(told.select("anchor", "run", "a", "b", "lo"))
    window = F.struct((F.col("start") + F.col("a")).alias("from"), (F.col("start") + F.col("b")).alias("to"), (F.col("lo") < F.col("doc_id")).alias("gone"))
    met = cand.join(masks, ["anchor", "run"]).groupBy(*_KEY).agg(F.collect_list(window).alias("found"))
    found = materialise(met, f"found-{length}")
    for done in (cand, classes, needed, prints):
        discard(done)
    return found


def merged(start, stop):
    """Intervals that touch or overlap, united."""
    import numpy as np

    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.append(True, start[1:] > stop[:-1])) if len(start) else np.empty(0, np.int64)
    return start[new], stop[np.append(new[1:], len(start)) - 1] if len(new) else start


def _longer(found: DataFrame, segs: DataFrame, length: int) -> DataFrame:
    """Pieces of documents with room for a window of twice the length: ``doc_id, unit, start, body`` with the hashes of their words."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from . import textcore as tc

        for part in (part for batch in batches for part in tc.slices(batch, "body")):
            hashes, first = word_column(part.column(3))
            base = part.column(2).to_pylist()
            rows = []
            for i, lists in enumerate(part.column(4)):
                a, b, _ = (f.to_numpy(zero_copy_only=False) for f in lists.values.flatten())
                for s, e in zip(*merged(a, b), strict=True):
                    at, to = s - base[i] + first[i], e - base[i] + first[i] + length - 1
                    if e - s > length and at >= first[i] and to <= first[i + 1]:
                        rows.append((part.column(0)[i].as_py(), part.column(1)[i].as_py(), int(s), hashes[at:to].tobytes()))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*_KEY, "start", "body"])

    return _with_body(found, segs).select(*_KEY, "start", "body", "found").mapInArrow(frugal(run), "doc_id long, unit int, start long, body binary")


def _kept(docs: DataFrame, length: int) -> DataFrame:
    """``doc_id, unit, n_removed, kept_sha256, kept, spans`` of texts with their ``found`` windows that go."""

    def run(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import numpy as np
        import pyarrow as pa

        from . import textcore as tc

        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        for part in (part for batch in batches for part in tc.slices(batch, "body")):
            rows = []
            for doc, unit, text, lists in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3), strict=True):
                a, b, gone = (f.to_numpy(zero_copy_only=False) for f in lists.values.flatten())
                gone = gone.astype(bool)
                a, b = (x.tolist() for x in merged(a[gone], b[gone] + length - 1))
                ws = text.encode().split()
                kept = b" ".join(w for s, e in zip([0, *b], [*a, len(ws)], strict=True) for w in ws[s:e])
                rows.append((doc, unit, int(np.sum(b) - np.sum(a)), sha256(kept).hexdigest(), kept.decode(), [{"from": s, "to": e} for s, e in zip(a, b, strict=True)]))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), kind]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*_KEY, "n_removed", "kept_sha256", "kept", "spans"])

    return docs.select(*_KEY, "body", "found").mapInArrow(frugal(run), "doc_id long, unit int, n_removed long, kept_sha256 string, kept string, spans array<struct<from:long,to:long>>")


def _whole(segs: DataFrame) -> DataFrame:
    """``doc_id, unit, n_words, sha`` of every row."""

    def run(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import pyarrow as pa

        from . import textcore as tc

        for part in (part for batch in batches for part in tc.slices(batch, "body")):
            n, sha = [], []
            for text in part.column(2).cast(pa.binary() if pa.types.is_string(part.column(2).type) else pa.large_binary()).to_pylist():
                ws = text.split()
                n.append(len(ws))
                sha.append(sha256(b" ".join(ws)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=[*_KEY, "n_words", "sha"])

    return segs.select(*_KEY, "body").mapInArrow(frugal(run), "doc_id long, unit int, n_words long, sha string")


def segments(docs: DataFrame) -> DataFrame:
    """``doc_id, unit, start, body``: whole texts; ``unit`` tells texts under one id apart."""
    body = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(body).alias("unit"), F.lit(0).cast("long").alias("start"), body.alias("body"))


def levels(docs: DataFrame, length: int = 50) -> Iterator[tuple[int, DataFrame]]:
    """(window length, windows found) of each level, from ``length`` on and doubling, as long as windows survive."""
    segs = segments(docs.where("doc_id is not null"))
    k = (length + 1) // 2
    found = extend(segs, length, k)
    while found is not None:
        yield length, found
        cut = materialise(_longer(found, segs, length), f"pieces-{2 * length}")
        discard(segs)
        segs, length, k = cut, 2 * length, length
        found = None if segs.isEmpty() else extend(segs, length, k)
    discard(segs)


def _changed(docs: DataFrame, length: int) -> DataFrame:
    """``doc_id, unit, n_removed, kept_sha256, kept, spans, longest`` of the texts that lose words."""
    src = segments(docs.where("doc_id is not null"))
    changed, reached = None, None
    for size, found in levels(docs, length):
        going = found.where(F.exists("found", lambda x: x["gone"]))
        if changed is None:
            going = materialise(going, "going")
            changed = materialise(_kept(_with_body(going, src), length).dropDuplicates(_KEY), "kept")
            discard(going)
        tall = going.select(*_KEY, F.lit(size).cast("long").alias("size")) if size > length else changed.select(*_KEY, F.lit(size).cast("long").alias("size"))
        tall = tall if size == length else materialise(tall, "tall", light=True)
        reached = tall if reached is None else reached.unionByName(tall)
    if changed is None:
        spans = "array<struct<from:long,to:long>>"
        return src.sparkSession.createDataFrame([], f"doc_id long, unit int, n_removed long, kept_sha256 string, kept string, spans {spans}, longest long")
    return changed.join(reached.groupBy(*_KEY).agg(F.max("size").alias("longest")), _KEY)


def removals(docs: DataFrame, length: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, spans, longest`` of every row; the last two are null where nothing goes.

    ``spans``: words ``from <= i < to`` that go. ``longest``: the greatest of the lengths ``length``, twice that, four times that ..., of which a window of the
    document also starts in a document with a smaller id.
    """
    rows = _whole(segments(docs)).alias("w")
    found = _changed(docs, length).drop("kept").alias("f")
    out = rows.join(found, F.expr("w.doc_id = f.doc_id and w.unit = f.unit"), "left")
    return out.select("w.doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "spans", "longest")


def dedup(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` without the removed words; texts that lose any are their kept words joined by one space, the others stay as they are."""
    found = _changed(docs, length).select(F.col("doc_id").alias("f_id"), F.col("unit").alias("f_unit"), F.col("kept").alias("f_kept")).alias("f")
    same = F.expr("cast(d.doc_id as long) = f.f_id and hash(coalesce(d.text, '')) = f.f_unit")
    text = F.coalesce("f.f_kept", "d.text")
    own = lambda c, t: text if c == "text" else F.length(text).cast(t) if c == "n_chars" else F.col(f"d.`{c}`")
    return docs.alias("d").join(found, same, "left").select(*[own(c, t).alias(c) for c, t in docs.dtypes])

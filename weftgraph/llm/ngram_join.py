"""N-gram Jaccard self-join by rare-first prefix filtering.

1. ``_scatter``: documents become sets of 48-bit word-shingle hashes, cut by hash into buckets. A task ships the hashes of
   some thousand documents (a *unit*) at 7 bytes each; a shingle common within a unit travels as one count, its occurrences
   go straight on to the unit.
2. ``_frequencies``: each bucket counts exact document frequencies and returns those over 1 to the units. A shingle of
   frequency 1 is in no intersection, but it fills places of the prefix.
3. ``_sets``: each unit orders its sets rare-first (frequency, then hash: one total order for all documents). A document
   whose prefix (n - ceil(t n) + 1 places) holds only shingles of frequency 1 has no partner and goes no further.
4. Documents with equal sets are one class. Prefix n-grams of two classes or more are joined with themselves: classes whose commonest
   shared prefix n-gram is the same, and whose sizes are close, lie together in a *block* (a hot one is cut into many), and two blocks
   that hold one prefix n-gram, with sizes that can link, are one work item. A pair of classes meets in the item of its two blocks and
   nowhere else, and blocks that share no prefix n-gram never meet.
5. ``_verify``: within an item pairs come from common prefix n-grams, pass length, positional and suffix filters, and are verified once by
   exact intersection. Only a spanning forest of the links leaves it.

No group of documents is ever in one task or on the driver as a whole, and no pair list of a group is made: an n-gram that ``c`` classes have
makes at most ``(c / BLOCK) ** 2`` items when they share their commonest n-gram, and never more than the pairs it stands for.

Defined results: a null or empty text has an empty set and is linked with nothing; fewer than ``k`` words are one shingle;
rows with a null ``doc_id`` take no part and get null results; repeated rows are in one class, and an id that stands on several different
texts is several members; columns other than ``doc_id`` and ``text`` are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import connected_components, discard, materialise, n_partitions
from .textcore import SLICE_ROWS, frugal, frugal_group

UNIT_BYTES = 8 << 20
#: Rows of a unit are numbered by 16 bits.
UNIT_DOCS = SLICE_ROWS
#: Occurrences within a unit from which a shingle travels as a count.
COMMON = 32
#: Occurrences in one row of those that go straight on.
PASSED = 8192
#: Classes in a block, and n-grams of them all together.
BLOCK = 96
BLOCK_GRAMS = 100_000
#: Small work items in one group.
ITEMS = 32
#: Up to so many ids (8 bytes each) of near duplicates are broadcast.
BROADCAST_IDS = 1_000_000
#: A class with over one in so many rows is joined by broadcast; there are fewer of them than this number.
HOT_SHARE = 1000
_SCATTER = "bucket long, unit long, kind int, at binary, lo binary, hi binary"
_FREQ = "unit long, kind int, at binary, lo binary, hi binary, df binary"
LIGHT, META, COMMON_ROWS, COMMON_COUNTS = 0, 1, 2, 3


def _ceil_share(n, num: int, den: int):
    return (num * n + den - 1) // den


def _scatter(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from . import textcore as tc

        names = ["bucket", "unit", "kind", "at", "lo", "hi"]
        unit = TaskContext.get().partitionId() << 32

        def split(h):
            return (h & np.uint64(0xFFFFFFFF)).astype("<u4"), (h >> np.uint64(32)).astype("<u2")

        def rows_of(at, h, kind, width):
            bucket = ((h >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(bucket.astype(np.uint32), kind="stable")
            bucket, at = bucket[order], at[order].astype(width)
            lo, hi = split(h[order])
            cut = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1)))
            for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True):
                yield int(bucket[a]), unit, kind, at[a:b].tobytes(), lo[a:b].tobytes(), hi[a:b].tobytes()

        def flush(ids, values, at):
            v, r = np.concatenate(values), np.concatenate(at)
            n = np.bincount(r, minlength=len(ids)).astype("<u8")
            sig = np.zeros((2, len(ids)), np.uint64)
            if len(v):
                first = np.searchsorted(r, np.arange(len(ids)))
                live = n > 0
                for i, salt in enumerate((0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)):
                    total = np.zeros(len(v) + 1, np.uint64)
                    np.cumsum(tc.mix(v + np.uint64(salt)), out=total[1:])
                    sig[i, live] = total[first[live] + n[live].astype(np.int64)] - total[first[live]]
            spread = lambda i: int(tc.mix(np.array([unit + i], np.uint64))[0] % np.uint64(buckets))
            out = [(spread(0), unit, META, np.asarray(ids, "<i8").tobytes(), n.tobytes(), sig.astype("<u8").tobytes())]
            if len(v):
                h = v >> np.uint64(16)
                uniq, inv, count = np.unique(h, return_inverse=True, return_counts=True)
                often = count >= COMMON
                heavy = often[inv]
                out.extend(rows_of(r[~heavy], h[~heavy], LIGHT, "<u2"))
                if heavy.any():
                    own = np.flatnonzero(heavy)
                    for i in range(0, len(own), PASSED):
                        lo, hi = split(h[own[i : i + PASSED]])
                        out.append((spread(i + 1), unit, COMMON_ROWS, r[own[i : i + PASSED]].astype("<u2").tobytes(), lo.tobytes(), hi.tobytes()))
                    out.extend(rows_of(count[often], uniq[often], COMMON_COUNTS, "<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 3], strict=True)],
                names=names,
            )

        ids, values, at, held = [], [], [], 0
        for batch in batches:
            for part in tc.slices(batch, "text"):
                raw, off, _ = tc.buffers(part.column(1))
                start, end, first = tc.words(raw, off)
                v, r = tc.shingles(tc.word_hashes(raw, start, end), first, k)
                v, r = tc.distinct_per_doc(v, r)
                if ids and (held + len(raw) > UNIT_BYTES or len(ids) + part.num_rows > UNIT_DOCS):
                    yield flush(ids, values, at)
                    ids, values, at, held, unit = [], [], [], 0, unit + 1
                values.append(v)
                at.append(r + len(ids))
                ids.extend(part.column(0).to_pylist())
                held += len(raw)
        if ids:
            yield flush(ids, values, at)

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), _SCATTER)


def _frequencies(scattered: DataFrame) -> DataFrame:
    def run(table):
        import numpy as np
        import pyarrow as pa

        unit, kind = table["unit"].to_numpy(), table["kind"].to_numpy()
        at, lo, hi = (table[c].to_pylist() for c in ("at", "lo", "hi"))
        out = [(int(unit[i]), int(kind[i]), at[i], lo[i], hi[i], None) for i in np.flatnonzero((kind == META) | (kind == COMMON_ROWS))]
        own = np.flatnonzero((kind == LIGHT) | (kind == COMMON_COUNTS))
        if len(own):
            h = np.frombuffer(b"".join(lo[i] for i in own), "<u4").astype(np.uint64)
            h |= np.frombuffer(b"".join(hi[i] for i in own), "<u2").astype(np.uint64) << np.uint64(32)
            size = [len(hi[i]) // 2 for i in own]
            weight = np.concatenate([np.ones(s) if kind[i] == LIGHT else np.frombuffer(at[i], "<u4") for i, s in zip(own, size, strict=True)])
            uniq, inv = np.unique(h, return_inverse=True)
            df = np.minimum(np.bincount(inv, weights=weight), 65535).astype("<u2")[inv]
            end = np.cumsum(size)
            for i, s, e in zip(own, size, end, strict=True):
                mine = df[e - s : e]
                keep = mine > 1
                if keep.any():
                    wide = "<u2" if kind[i] == LIGHT else "<u4"
                    out.append(
                        (
                            int(unit[i]), int(kind[i]), np.frombuffer(at[i], wide)[keep].tobytes(), np.frombuffer(lo[i], "<u4")[keep].tobytes(),
                            np.frombuffer(hi[i], "<u2")[keep].tobytes(), mine[keep].tobytes(),
                        )
                    )
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), *[pa.binary()] * 4], strict=True)], names=["unit", "kind", "at", "lo", "hi", "df"])

    return scattered.groupBy("bucket").applyInArrow(frugal_group(run), _FREQ)


def _sets(freq: DataFrame, num: int, den: int) -> DataFrame:
    """``doc_id, n, sig1, sig2, keys``: keys is null for documents that can have no partner with another set."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        kind = table["kind"].to_numpy()
        at, lo, hi, df = (table[c].to_pylist() for c in ("at", "lo", "hi", "df"))
        (meta,) = np.flatnonzero(kind == META)
        ids, n = np.frombuffer(at[meta], "<i8"), np.frombuffer(lo[meta], "<u8").astype(np.int64)
        sig = np.frombuffer(hi[meta], "<i8").reshape(2, -1)

        def hashes(which):
            h = np.frombuffer(b"".join(lo[i] for i in which), "<u4").astype(np.uint64)
            return h | np.frombuffer(b"".join(hi[i] for i in which), "<u2").astype(np.uint64) << np.uint64(32)

        light = np.flatnonzero(kind == LIGHT)
        row = np.frombuffer(b"".join(at[i] for i in light), "<u2").astype(np.int64)
        key = hashes(light) | np.frombuffer(b"".join(df[i] for i in light), "<u2").astype(np.uint64) << np.uint64(48)
        common = np.flatnonzero(kind == COMMON_ROWS)
        if len(common):
            counts = np.flatnonzero(kind == COMMON_COUNTS)
            known = hashes(counts)
            level = np.frombuffer(b"".join(df[i] for i in counts), "<u2").astype(np.uint64)
            order = np.argsort(known)
            h = hashes(common)
            level = level[order][np.searchsorted(known, h, sorter=order)]
            row = np.concatenate([row, np.frombuffer(b"".join(at[i] for i in common), "<u2").astype(np.int64)])
            key = np.concatenate([key, h | level << np.uint64(48)])
        shared = np.bincount(row, minlength=len(ids))
        reach = (shared > 0) & (shared >= _ceil_share(n, num, den))
        keep = reach[row]
        row, key = row[keep], key[keep]
        order = np.lexsort((key, row))
        row, key = row[order], key[order].astype("<u8")
        a, b = np.searchsorted(row, np.arange(len(ids))), np.searchsorted(row, np.arange(len(ids)), side="right")
        keys = [key[s:e].tobytes() if ok else None for s, e, ok in zip(a, b, reach, strict=True)]
        return pa.table([pa.array(ids), pa.array(n), pa.array(sig[0]), pa.array(sig[1]), pa.array(keys, pa.binary())], names=["doc_id", "n", "sig1", "sig2", "keys"])

    return freq.groupBy("unit").applyInArrow(frugal_group(run), "doc_id long, n long, sig1 long, sig2 long, keys binary")


def _prefixes(classes: DataFrame, num: int, den: int) -> DataFrame:
    """``key, cid, n``: n-grams of frequency over 1 in the prefix of each class."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids, sizes, blobs = (batch.column(i) for i in range(3))
            keys, owner, size = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for cid, n, blob in zip(ids.to_pylist(), sizes.to_pylist(), blobs, strict=True):
                own = np.frombuffer(blob.as_py(), "<i8")
                left = min(n - _ceil_share(n, num, den) + 1 - (n - len(own)), len(own))
                keys.append(own[:left])
                owner.append(np.full(left, cid))
                size.append(np.full(left, n))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, owner, size)], names=["key", "cid", "n"])

    return classes.select("cid", "n", "keys").mapInArrow(frugal(run), "key long, cid long, n long")


class Forest:
    """Union by smaller root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def region_links(sizes, keys, left, right, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between members ``left`` and ``right`` (index arrays, equal or disjoint).

    ``keys[i]``: the sorted (frequency, hash) keys of frequency over 1 of member i, ``sizes[i]``: its whole set size.
    """
    import numpy as np

    sizes = np.asarray(sizes, np.int64)
    room = np.zeros((len(left), len(right)), np.int64)  # most overlap that the first common prefix n-gram leaves

    def prefix(members):
        key, who, rest = [], [], []
        for i, x in enumerate(members):
            own, n = keys[x], int(sizes[x])
            unique = n - len(own)
            p = min(n - _ceil_share(n, num, den) + 1 - unique, len(own))
            if p > 0:
                key.append(own[:p])
                who.append(np.full(p, i))
                rest.append(n - unique - np.arange(p))
        if not key:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        key, who, rest = map(np.concatenate, (key, who, rest))
        order = np.argsort(key, kind="stable")
        return key[order], who[order], rest[order]

    lk, lw, lr = prefix(left)
    rk, rw, rr = prefix(right)
    for key in np.intersect1d(lk, rk)[::-1]:  # commonest first: the rarest common n-gram of a pair is written last
        a = slice(*np.searchsorted(lk, [key, key + np.uint64(1)]))
        b = slice(*np.searchsorted(rk, [key, key + np.uint64(1)]))
        if left is right and a.stop - a.start == 1 and b.stop - b.start == 1:
            continue
        room[np.ix_(lw[a], rw[b])] = np.minimum.outer(lr[a], rr[b])
    if left is right:
        room = np.triu(room, 1)
    i, j = np.nonzero(room)
    if not len(i):
        return []
    si, sj = sizes[left[i]], sizes[right[j]]
    need = _ceil_share(si + sj, num, num + den)
    ok = (den * np.minimum(si, sj) >= num * np.maximum(si, sj)) & (room[i, j] >= need)
    i, j, need = i[ok], j[ok], need[ok]
    if not len(i):
        return []
    # suffix filter: the order is cut at pivots; what two sets share lies part by part
    used = np.unique(np.concatenate([left[i], right[j]]))
    some = np.concatenate([keys[x][:: max(1, len(keys[x]) // 64)] for x in used])
    pivots = np.unique(np.quantile(some.astype(np.float64), np.linspace(0, 1, 18)[1:-1]).astype(np.uint64))
    parts = {x: np.diff(np.concatenate([[0], np.searchsorted(keys[x], pivots), [len(keys[x])]])) for x in used}
    lp = np.stack([parts.get(x, np.zeros(len(pivots) + 1, np.int64)) for x in left])
    rp = lp if left is right else np.stack([parts.get(x, np.zeros(len(pivots) + 1, np.int64)) for x in right])
    ok = np.zeros(len(i), bool)
    for s in range(0, len(i), 65536):
        w = slice(s, s + 65536)
        ok[w] = np.minimum(lp[i[w]], rp[j[w]]).sum(axis=1) >= need[w]
    i, j, need = i[ok], j[ok], need[ok]
    if len(i) > 64:
        members = np.unique(np.concatenate([left[i], right[j]]))
        place = {x: p for p, x in enumerate(members.tolist())}
        flat = np.concatenate([keys[x] for x in members])
        owner = np.repeat(np.arange(len(members)), [len(keys[x]) for x in members])
        uniq, col, count = np.unique(flat, return_inverse=True, return_counts=True)
        twice = count > 1
        column = np.cumsum(twice) - 1
        keep = twice[col]
        owner, col = owner[keep], column[col[keep]]
        common = np.zeros((len(members), len(members)), np.float32)
        order = np.argsort(col, kind="stable")
        owner, col = owner[order], col[order]
        for s in range(0, int(twice.sum()), 4096):
            a, b = np.searchsorted(col, [s, s + 4096])
            m = np.zeros((len(members), 4096), np.float32)
            m[owner[a:b], col[a:b] - s] = 1
            common += m @ m.T
        got = common[[place[x] for x in left[i].tolist()], [place[x] for x in right[j].tolist()]].astype(np.int64)
    else:
        got = np.array([len(np.intersect1d(keys[left[a]], keys[right[b]], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    linked = got >= need
    forest, out = Forest(len(sizes)), []
    for a, b in zip(left[i[linked]].tolist(), right[j[linked]].tolist(), strict=True):
        if forest.join(a, b):
            out.append((a, b))
    return out


def _blocks(shared: DataFrame, num: int, den: int) -> DataFrame:
    """``cid, block, big``: classes by their commonest shared prefix n-gram and a band of sizes, cut by hash where there are many."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))) if num < den else F.col("n")
    homes = shared.groupBy("cid").agg(F.max(F.struct("c", "key"))["key"].alias("home"), F.first("n").alias("n")).withColumn("band", band)
    homes = materialise(homes, "homes")
    cuts = homes.groupBy("home", "band").agg(F.greatest(F.ceil(F.count("*") / F.lit(float(BLOCK))), F.ceil(F.sum("n") / F.lit(float(BLOCK_GRAMS)))).alias("cuts"))
    placed = homes.join(cuts, ["home", "band"])
    block = F.xxhash64("home", "band", F.pmod(F.xxhash64("cid"), F.col("cuts")))
    placed = materialise(placed.select("cid", block.alias("block"), (F.col("cuts") > 1).alias("big")), "blocks")
    discard(homes)
    return placed


def _items(shared: DataFrame, placed: DataFrame, num: int, den: int) -> DataFrame:
    """``i, j, big``: each two blocks (or one with itself) that hold a prefix n-gram in common and sizes that can link, once."""
    held = shared.join(placed, "cid").groupBy("key", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("m"), F.max("big").alias("big"))
    held = materialise(held, "held")
    a = held.select("key", *[F.col(c).alias(f"a_{c}") for c in ("block", "lo", "hi", "m", "big")])
    b = held.select("key", *[F.col(c).alias(f"b_{c}") for c in ("block", "lo", "hi", "big")])
    close = (den * F.col("a_hi") >= num * F.col("b_lo")) & (den * F.col("b_hi") >= num * F.col("a_lo"))
    apart = (F.col("a_block") < F.col("b_block")) | ((F.col("a_block") == F.col("b_block")) & (F.col("a_m") > 1))
    met = a.join(b, "key").where(apart & close).groupBy(F.col("a_block").alias("i"), F.col("b_block").alias("j"))
    out = materialise(met.agg(F.max(F.col("a_big") | F.col("b_big")).alias("big")), "items")
    discard(held)
    return out


def _verify(work: DataFrame, num: int, den: int) -> DataFrame:
    def run(table):
        import numpy as np
        import pyarrow as pa

        left, right, block = (table[c].to_numpy() for c in ("i", "j", "block"))
        cid, n = table["cid"].to_numpy(), table["n"].to_numpy()
        keys = [np.frombuffer(b.as_buffer(), "<u8") for b in table["keys"]]
        order = np.lexsort((right, left))
        a, b = [], []
        for part in np.split(order, np.flatnonzero((np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)) + 1):
            if len(part) < 2:
                continue
            i, j = left[part[0]], right[part[0]]
            one = part[block[part] == i]
            two = one if i == j else part[block[part] == j]
            for x, y in region_links(n, keys, one, two, num, den) if len(one) and len(two) else ():
                a.append(int(cid[x]))
                b.append(int(cid[y]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return work.groupBy("cell").applyInArrow(frugal_group(run), "a long, b long")


def similarity_classes(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; two sets link when ``den * common >= num * union``."""
    parts = n_partitions(docs.sparkSession)
    sets = materialise(_sets(_frequencies(_scatter(docs, k, 4 * parts)), num, den), "sets")
    sig = ["n", "sig1", "sig2"]
    named = sets.where("n > 0").groupBy(*sig).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("keys", ignorenulls=True).alias("keys"))
    named = materialise(named.withColumn("cid", F.xxhash64(*sig)), "classes")
    classes = named.where("keys is not null").select("cid", "n", "keys")
    prefixes = materialise(_prefixes(classes, num, den), "prefixes")
    often = prefixes.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    shared = materialise(prefixes.join(often, "key"), "shared")
    discard(prefixes)
    placed = _blocks(shared, num, den)
    items = _items(shared, placed, num, den)
    discard(shared)
    cells = max(parts, items.count() // ITEMS)
    cell = F.when(F.col("big"), F.xxhash64("i", "j")).otherwise(F.pmod(F.xxhash64("i", "j"), F.lit(cells)))
    ends = items.select("i", "j", cell.alias("cell"), F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    work = ends.join(placed.select("cid", "block"), "block").join(classes, "cid")
    links = materialise(_verify(work, num, den), "links")
    discard(placed)
    discard(items)
    found = materialise(connected_components(links), "found")
    discard(links)
    least = found.join(named.select(F.col("cid").alias("id"), "rep"), "id").groupBy("component").agg(F.min("rep").alias("least"))
    linked = found.join(least, "component").select(F.col("id").alias("cid"), "least")
    ids = named.join(linked, "cid", "left").select(*sig, "copies", F.coalesce("least", "rep").alias("component_id"))
    ids = materialise(ids, "class-ids")
    discard(found)
    # a class may hold a third of all rows
    bound = sets.count() // HOT_SHARE
    rows = sets.where("n > 0").select("doc_id", *sig)
    hot = F.broadcast(ids.where(F.col("copies") > bound).drop("copies"))
    rare = rows.join(hot, sig, "left_anti").join(ids.where(F.col("copies") <= bound).drop("copies"), sig)
    full = rows.join(hot, sig).unionByName(rare).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    none = F.lit(None).cast("long")
    nameless = docs.where("doc_id is null").select(none.alias("doc_id"), none.alias("n_shingles"), none.alias("component_id"))
    return full.unionByName(empty).unionByName(nameless)


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their class; columns unchanged. Rows with a null id stay."""
    gone = similarity_classes(docs, k, num, den).where("doc_id != component_id").select("doc_id").distinct()
    gone = materialise(gone, "gone", light=True)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = docs.alias("d").join(gone.alias("g"), F.expr("cast(d.doc_id as long) = g.doc_id"), "left_anti")
    return kept.select(*[F.col(f"d.`{c}`") for c in docs.columns])

"""Packing of token sequences: best-fit decreasing with a segment tree over remaining capacity.

Each task packs the documents of its partition in blocks of bounded size, so nothing is shuffled and a lost executor
only repeats its own partitions. Overlong documents are first cut into full windows; what remains is placed, longest
first, in the open window with the least sufficient room. The few windows that stay poorly filled are unpacked and laid
end to end, and the last of them is cut at powers of two, at which no padding is needed.

Defined results: a null text is an empty one and still carries its end id; repeated rows are packed once each; a null
``doc_id`` is carried through; columns other than ``doc_id`` and ``text`` are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textcore import frugal
from .tokens import default_path

#: Ids a block holds at most before it is packed (a longer document is a block of its own).
BLOCK_IDS = 3 << 20


class CapacityTree:
    """Which remaining capacities have open windows, and the tightest that is at least a need."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, window) with the least room >= need."""
        at, count = need + self.size, self.count
        if not count[at]:
            while True:
                if at & 1 == 0 and count[at + 1]:
                    at += 1
                    break
                at >>= 1
                if at <= 1:
                    return None
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            count[at] -= 1
            at >>= 1
        return room, self.open[room].pop()


def pack_lengths(lengths: list[int], window: int = 4096, poor: float = 0.9) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (item, start, length). Every unit of every item lies in exactly one piece."""
    out: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for item, n in enumerate(lengths):
        full = n // window
        out.extend([(item, k * window, window)] for k in range(full))
        if n % window:
            rest.append((n % window, item, full * window))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree = CapacityTree(window)
    bins: list[list[tuple[int, int, int]]] = []
    for n, item, start in rest:
        got = tree.take(n)
        if got is None:
            room, at = window, len(bins)
            bins.append([])
        else:
            room, at = got
        bins[at].append((item, start, n))
        if room > n:
            tree.add(room - n, at)
    filled = [sum(p[2] for p in b) for b in bins]
    out.extend(b for b, f in zip(bins, filled, strict=True) if f >= poor * window)
    loose = [p for b, f in zip(bins, filled, strict=True) if f < poor * window for p in b]
    total, size = sum(p[2] for p in loose), 0
    cur: list[tuple[int, int, int]] = []
    for item, start, n in loose:
        while n:
            if not size:
                size = window if total >= window else 1 << (total.bit_length() - 1)
                room = size
            take = min(n, room)
            cur.append((item, start, take))
            start, n, room, total = start + take, n - take, room - take, total - take
            if not room:
                out.append(cur)
                cur, size = [], 0
    if cur:
        out.append(cur)
    return out


def pack(docs: DataFrame, window: int = 4096, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Pieces ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``; ``ids`` are little-endian unsigned 32-bit."""
    path = path or default_path()
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from .textcore import slices
        from .tokens import tokenizer

        tok = tokenizer(path)
        end = end_id.to_bytes(4, "little")
        next_id = TaskContext.get().partitionId() << 36

        def flush(keys, data):
            nonlocal next_id
            cols = [[] for _ in range(7)]
            size = 0
            for seq in pack_lengths([len(x) // 4 for x in data], window):
                offset = 0
                for item, start, n in seq:
                    ids = data[item][4 * start : 4 * (start + n)]
                    for c, v in zip(cols, (keys[item], start, n, ids, len(data[item]) // 4, next_id, offset), strict=True):
                        c.append(v)
                    offset += n
                    size += n
                next_id += 1
                if size > 1 << 20:
                    yield batch_of(cols)
                    cols, size = [[] for _ in range(7)], 0
            if cols[0]:
                yield batch_of(cols)

        def batch_of(cols):
            kinds = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=schema.names)

        keys, data, held, key_type = [], [], 0, None
        for batch in batches:
            key_type = batch.schema.field("doc_id").type
            for part in slices(batch, "text"):
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = tok.ids(text) + end
                    if held and held + len(ids) > 4 * BLOCK_IDS:
                        yield from flush(keys, data)
                        keys, data, held = [], [], 0
                    keys.append(key)
                    data.append(ids)
                    held += len(ids)
        if keys:
            yield from flush(keys, data)

    return docs.select("doc_id", "text").mapInArrow(frugal(run), schema)

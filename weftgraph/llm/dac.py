"""Token-id files of directly addressable codes.

An id is split into chunks of ``bits`` bits. Level 0 holds the lowest chunk of every id; a continuation bitmap tells
which ids go on, and the next chunks of those, in order, are level 1, and so forth. A rank directory (ones before each
block of 512 bits) turns "the i-th id continues" into its place on the next level, so any id is read without decoding
what stands before it.

Layout of a shard, little-endian: magic ``DAC1``, bits u32, levels u32, n_docs u64, n_ids u64; doc ids i64 x n_docs and
a null bitmap; ends u64 x n_docs (ids up to and with each document, within the shard); then for each level: n u64,
chunk bytes, bitmap bytes, rank directory u32.

Shards are written by Spark's committed file writer as rows of an uncompressed binary column, one row group each: a retried task
leaves no half shard, and any store that Spark writes to will do. Beside the bytes stand the first and last document of the shard, so ``lookup``
reads the one row group that holds a document, finds it in the shard's own list of documents by bisection and takes a chunk
from each level. ``index`` has the number of ids before each shard.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import n_partitions
from .textcore import frugal
from .tokens import default_path

SHARD_IDS = 1 << 18
_SHARDS = "part long, shard long, n_docs long, n_ids long, first_doc long, last_doc long, blob binary"
#: Writer options under which a shard is a row group of its own and its bytes stand in the file as they are.
_PLAIN = {"compression": "none", "parquet.block.row.count.limit": "1", "parquet.enable.dictionary": "false"}
_RANK = 512


def encode_shard(doc_ids: list[int | None], arrays: list[bytes], bits: int = 8) -> bytes:
    """A shard of documents whose ids are little-endian unsigned 32-bit arrays."""
    import numpy as np

    if not 1 <= bits <= 8:
        raise ValueError("chunks of 1 to 8 bits")
    ids = np.frombuffer(b"".join(arrays), "<u4")
    ends = np.cumsum([len(a) // 4 for a in arrays], dtype=np.uint64) if arrays else np.empty(0, np.uint64)
    null = np.array([d is None for d in doc_ids], bool)
    keys = np.array([0 if d is None else d for d in doc_ids], np.int64)
    levels = []
    rest = ids
    while True:
        chunk = (rest & np.uint32((1 << bits) - 1)).astype(np.uint8)
        rest = rest >> np.uint32(bits)
        more = rest > 0
        packed = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more, np.arange(0, len(more), _RANK)) if len(more) else np.zeros(0, np.int64)
        rank = np.concatenate([[0], np.cumsum(blocks)])[: max(1, len(blocks))].astype("<u4")
        levels.append(struct.pack("<Q", len(chunk)) + chunk.tobytes() + packed.tobytes() + rank.tobytes())
        rest = rest[more]
        if not len(rest):
            break
    head = b"DAC1" + struct.pack("<IIQQ", bits, len(levels), len(keys), len(ids))
    return head + keys.astype("<i8").tobytes() + np.packbits(null, bitorder="little").tobytes() + ends.astype("<u8").tobytes() + b"".join(levels)


class Shard:
    """Random access to a shard."""

    def __init__(self, blob: bytes):
        import numpy as np

        if blob[:4] != b"DAC1":
            raise ValueError("not a shard")
        self.bits, levels, self.n_docs, self.n_ids = struct.unpack_from("<IIQQ", blob, 4)
        at = 28
        self.doc_ids = np.frombuffer(blob, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        size = (self.n_docs + 7) // 8
        self.null = np.unpackbits(np.frombuffer(blob, np.uint8, size, at), bitorder="little")[: self.n_docs].astype(bool)
        at += size
        self.ends = np.frombuffer(blob, "<u8", self.n_docs, at)
        at += 8 * self.n_docs
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", blob, at)
            at += 8
            chunk = np.frombuffer(blob, np.uint8, n, at)
            at += n
            bitmap = np.frombuffer(blob, np.uint8, (n + 7) // 8, at)
            at += (n + 7) // 8
            rank = np.frombuffer(blob, "<u4", max(1, -(-n // _RANK)), at)
            at += 4 * len(rank)
            self.levels.append((chunk, bitmap, rank))

    def _ones_before(self, level: int, i: int) -> int:
        _, bitmap, rank = self.levels[level]
        block = i // _RANK
        at = block * _RANK // 8
        part = int.from_bytes(bitmap[at : i // 8 + 1].tobytes(), "little") & ((1 << (i - block * _RANK)) - 1)
        return int(rank[block]) + part.bit_count()

    def token(self, i: int) -> int:
        """The i-th id of the shard."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for level, (chunk, bitmap, _) in enumerate(self.levels):
            value |= int(chunk[i]) << shift
            shift += self.bits
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i = self._ones_before(level, i)
        return value

    def span(self, start: int, stop: int):
        """Ids start..stop-1 as an unsigned 32-bit array."""
        import numpy as np

        out = np.zeros(stop - start, "<u4")
        where, lo, hi, shift = np.arange(stop - start), start, stop, 0
        for level, (chunk, bitmap, _) in enumerate(self.levels):
            if hi <= lo:
                break
            out[where] |= chunk[lo:hi].astype(np.uint32) << np.uint32(shift)
            shift += self.bits
            first = lo // 8
            more = np.unpackbits(bitmap[first : -(-hi // 8)], bitorder="little")[lo - 8 * first : hi - 8 * first].astype(bool)
            where = where[more]
            if not len(where):
                break
            lo = self._ones_before(level, lo)
            hi = lo + len(where)
        return out

    def find(self, doc_id: int | None) -> int | None:
        """The number of the first document with that id, which are in ascending order with null ones first."""
        import numpy as np

        nulls = int(self.null.sum())
        if doc_id is None:
            return 0 if nulls else None
        k = nulls + int(np.searchsorted(self.doc_ids[nulls:], doc_id))
        return k if k < self.n_docs and int(self.doc_ids[k]) == doc_id else None

    def document(self, k: int):
        """Ids of the k-th document."""
        return self.span(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write_tokens(docs: DataFrame, out: str, end_id: int = 1, bits: int = 8, path: str | None = None, partitions: int | None = None) -> None:
    """Encode every row of ``docs`` and write shards and index below ``out`` in ascending ``doc_id`` order.

    Texts, not ids, are range-partitioned, as they are smaller. A null text is empty, a null ``doc_id`` comes first,
    rows with equal ids are ordered by text, other columns are ignored, and an empty table gives no shards. ``doc_id``
    is an integer. The driver sees one number for each partition.
    """
    spark = docs.sparkSession
    path = path or default_path()
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from .textcore import slices
        from .tokens import tokenizer

        tok, end = tokenizer(path), end_id.to_bytes(4, "little")
        part, shard = TaskContext.get().partitionId(), 0
        keys, data, held = [], [], 0

        def made():
            blob = encode_shard(keys, data, bits)
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int64()),
                    "shard": pa.array([shard], pa.int64()),
                    "n_docs": pa.array([len(keys)], pa.int64()),
                    "n_ids": pa.array([held // 4], pa.int64()),
                    "first_doc": pa.array([next((k for k in keys if k is not None), None)], pa.int64()),
                    "last_doc": pa.array([keys[-1]], pa.int64()),
                    "blob": pa.array([blob], pa.binary()),
                }
            )

        for batch in batches:
            for piece in slices(batch, "text"):
                for key, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    ids = tok.ids(text) + end
                    if held and held + len(ids) > 4 * SHARD_IDS:
                        yield made()
                        keys, data, held, shard = [], [], 0, shard + 1
                    keys.append(key)
                    data.append(ids)
                    held += len(ids)
        if keys:
            yield made()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions or n_partitions(spark), "doc_id")
    ordered.sortWithinPartitions("doc_id", "text").mapInArrow(frugal(run), _SHARDS).write.options(**_PLAIN).parquet(f"{out}/shards")
    sizes = spark.read.schema(_SHARDS).parquet(f"{out}/shards").select("part", "shard", "n_ids")
    total, bases = 0, []
    for r in sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        bases.append((r["part"], total))
        total += r["n"]
    base = spark.createDataFrame(bases, "part long, before long")
    w = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    index = sizes.withColumn("in_part", F.coalesce(F.sum("n_ids").over(w), F.lit(0))).join(base, "part")
    index.select("part", "shard", (F.col("before") + F.col("in_part")).alias("base")).write.parquet(f"{out}/index")


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, decoded from the files below ``out``."""
    shards = spark.read.schema(_SHARDS).parquet(f"{out}/shards").select("part", "shard", "blob")
    index = spark.read.schema("part long, shard long, base long").parquet(f"{out}/index")
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    )

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for base, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = Shard(blob.as_py())
                ends = s.ends.astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                ids = s.span(0, s.n_ids).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(s.doc_ids, pa.int64(), mask=s.null),
                        pa.array(starts + base, pa.int64()),
                        pa.array(ends - starts, pa.int64()),
                        pa.array([ids[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)], pa.binary()),
                    ],
                    names=schema.names,
                )

    return shards.join(index, ["part", "shard"]).select("base", "blob").mapInArrow(frugal(run), schema)


def lookup(spark: SparkSession, out: str, doc_id: int | None, i: int) -> int:
    """The ``i``-th id of a document (the first one with that id), straight from the files: no index is built and nothing is decoded but this id.

    ``KeyError`` where there is no such document, ``IndexError`` where it is shorter.
    """
    shards = spark.read.schema(_SHARDS).parquet(f"{out}/shards")
    # null ids come before all others
    here = F.lit(True) if doc_id is None else (F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)
    place = shards.where(here).select("part", "shard").orderBy("part", "shard").first()
    if place is None:
        raise KeyError(doc_id)
    row = shards.where((F.col("part") == place["part"]) & (F.col("shard") == place["shard"])).select("blob").first()
    shard = Shard(bytes(row["blob"]))
    k = shard.find(doc_id)
    if k is None:
        raise KeyError(doc_id)
    start, stop = (int(shard.ends[k - 1]) if k else 0), int(shard.ends[k])
    if not 0 <= i < stop - start:
        raise IndexError(i)
    return shard.token(start + i)

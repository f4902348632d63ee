"""Corpus-wide byte 4-gram counts per label, gathered from all rows and merged in Spark."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import frugal

#: Distinct (label, gram) pairs a task holds before it hands its partial counts on.
HELD = 1 << 20
#: Bytes that stand before the first byte of a text.
PAD = 0x0A0A0A


def codes(raw, off):
    """The 4-gram that ends at each byte, as an unsigned 32-bit code; contexts do not cross documents."""
    import numpy as np

    x = raw.astype(np.uint32)
    out = x.copy()
    for k in (1, 2, 3):
        prev = np.full(len(x), 0x0A, np.uint32)
        prev[k:] = x[:-k] if k < len(x) else x[:0]
        for j in range(k):  # the first k bytes of each document see padding
            at = off[:-1] + j
            at = at[at < off[1:]]
            prev[at] = 0x0A
        out |= prev << np.uint32(8 * k)
    return out


def gram_counts(docs: DataFrame, label: str | None) -> DataFrame:
    """``label, gram, n`` over every row with a text and, if asked for, a label."""
    src = docs.select((F.col(label) if label else F.lit("")).cast("string").alias("label"), "text").where("label is not null and text is not null")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .textcore import buffers, slices

        held: dict[str, list] = {}

        def merged(label):
            keys = np.concatenate([k for k, _ in held[label]])
            counts = np.concatenate([c for _, c in held[label]])
            uniq, inv = np.unique(keys, return_inverse=True)
            return uniq, np.bincount(inv, weights=counts, minlength=len(uniq)).astype(np.int64)

        def rows(label):
            k, c = merged(label)
            return pa.RecordBatch.from_arrays(
                [pa.array([label] * len(k), pa.string()), pa.array(k.astype(np.int64)), pa.array(c)], names=["label", "gram", "n"]
            )

        for batch in batches:
            for part in slices(batch, "text"):
                labels = np.asarray(part.column(0).to_pylist(), object)
                for one in set(labels.tolist()):
                    raw, off, _ = buffers(part.filter(pa.array(labels == one)).column(1))
                    if len(raw):
                        held.setdefault(one, []).append(np.unique(codes(raw, off), return_counts=True))
                    if len(held.get(one, ())) >= 8:
                        held[one] = [merged(one)]
                if sum(len(k) for x in held.values() for k, _ in x) > 8 * HELD:
                    for one in held:
                        held[one] = [merged(one)]
                    if sum(len(x[0][0]) for x in held.values()) > HELD:
                        for one in held:
                            yield rows(one)
                        held.clear()
        for one in held:
            yield rows(one)

    return src.mapInArrow(frugal(run), "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))

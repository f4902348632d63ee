"""Where the terms of a text occur in it: an index of its three-byte strings, built once for all of its terms.

The places of a text are sorted by the three bytes that begin there. A term is looked up by the rarest of its own three-byte strings and verified at the places this gives, so the work
is that of one sort and of the places found, not terms times length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _grams(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.int32)
    return wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]


def places(text: bytes, terms: list[bytes]) -> list[np.ndarray]:
    """For each term the ascending byte offsets at which it begins, those that overlap included; an empty term has none."""
    out = [np.zeros(0, np.int64)] * len(terms)
    long = [k for k, t in enumerate(terms) if 3 <= len(t) <= len(text)]
    if long:
        grams = _grams(np.frombuffer(text, np.uint8))
        order = np.argsort(grams, kind="stable")
        ranked = grams[order]
        mine = [_grams(np.frombuffer(terms[k], np.uint8)) for k in long]
        first = np.cumsum([0, *(len(g) for g in mine[:-1])])
        flat = np.concatenate(mine)
        low, high = np.searchsorted(ranked, flat), np.searchsorted(ranked, flat, "right")
        for k, at, size in zip(long, first.tolist(), map(len, mine), strict=True):
            best = at + int(np.argmin(high[at : at + size] - low[at : at + size]))
            begin, term = order[low[best] : high[best]] - (best - at), terms[k]
            if size > 1:
                begin = np.array([b for b in begin.tolist() if b >= 0 and text.startswith(term, b)], np.int64)
            out[k] = begin
    for k, t in enumerate(terms):
        if 0 < len(t) < 3:
            found, b = [], text.find(t)
            while b >= 0:
                found.append(b)
                b = text.find(t, b + 1)
            out[k] = np.array(found, np.int64)
    return out


def apart(begin: np.ndarray, length: int) -> int:
    """How many of the places are left when those that overlap an earlier one that is left are not counted."""
    if len(begin) < 2 or int(np.diff(begin).min()) >= length:
        return len(begin)
    n, free = 0, -1
    for b in begin.tolist():
        if b >= free:
            n, free = n + 1, b + length
    return n


def slices_with(begin: np.ndarray, length: int, n: int, size: int, step: int) -> int:
    """How many of ``n`` slices, of ``size`` from every multiple of ``step``, hold one of the places whole."""
    low = np.maximum(0, -((size - begin - length) // step))
    high = np.minimum(n - 1, begin // step)
    before = np.concatenate([[-1], np.maximum.accumulate(high)[:-1]]) if len(begin) else high
    return int(np.maximum(0, high - np.maximum(low, before + 1) + 1).sum())


def counted(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    """``rows(doc_id, n, low, pieces, names)`` with lower-cased texts and terms to ``doc_id, name, tf, df, n``; ``names(name, low)``.

    ``pieces``, the lower-cased slices of a text, is needed only where the text is not ASCII; else offsets tell the slice.
    """
    own = rows.schema["doc_id"]
    fields = [own, T.StructField("name", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("df", T.LongType()), T.StructField("n", T.LongType())]
    step = size - overlap

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            which, out = [], []
            for i in range(batch.num_rows):
                n, low, pieces, names = (batch.column(c)[i].as_py() for c in range(1, 5))
                terms = [t["low"].encode() for t in names]
                at = places((low or "").encode(), terms)
                if pieces is None:
                    df = [slices_with(b, len(t), n, size, step) for b, t in zip(at, terms, strict=True)]
                else:
                    df = [sum(map(bool, held)) for held in zip(*([len(b) for b in places(p.encode(), terms)] for p in pieces), strict=True)] or [0] * len(terms)
                for t, term, b, d in zip(names, terms, at, df, strict=True):
                    tf = apart(b, len(term)) if low is not None or not term else None
                    out.append((t["name"], tf, d if term or low is None else n, n))
                which += [i] * len(names)
            cols = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[f.name for f in fields])

    return rows.select("doc_id", "n", "low", "pieces", "names").mapInArrow(run, T.StructType(fields))

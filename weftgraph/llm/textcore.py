"""Vectorised byte-level text kernels shared by the operators of this subpackage.

Everything works on the raw Arrow string buffers: a slice of documents is one ``uint8`` buffer plus an
``int64`` offset array, so no per-document Python loop is needed for splitting, hashing or shingling.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text a kernel handles at once; intermediates are about 60 times this. A longer document is one slice.
SLICE_BYTES = 512 << 10
#: Rows a kernel handles at once, so that row numbers are small.
SLICE_ROWS = 1 << 15

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = 0x9E3779B97F4A7C15
_ODD_INV = pow(_ODD, -1, 1 << 64)


def _byte_table(lower: bool) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(20240229))
    table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    if lower:
        table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


_TABLE = {True: _byte_table(True), False: _byte_table(False)}
#: Another table, for a second hash that is independent of the first.
SECOND_TABLE = np.random.Generator(np.random.PCG64(19991231)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: For comparison regardless of punctuation: ASCII white space, controls and punctuation all separate words.
LOOSE = np.zeros(256, bool)
LOOSE[:0x80] = True
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    LOOSE[ord(_a) : ord(_b) + 1] = False
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        fwd = np.full(size, _ODD, np.uint64)
        inv = np.full(size, _ODD_INV, np.uint64)
        fwd[0] = inv[0] = 1
        have = (np.cumprod(fwd), np.cumprod(inv))
        if size <= 8 * SLICE_BYTES:
            _POWERS[0] = have
    return have[0][:n], have[1][:n]


@functools.cache
def _libc():
    """The C library where it is glibc, told to give large arrays back to the system as soon as they are freed."""
    lib = ctypes.CDLL(None)
    if not hasattr(lib, "mallopt") or not hasattr(lib, "malloc_trim"):
        return None
    lib.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    return lib


def give_back() -> None:
    """Return what the task has freed to the system: Spark uses the worker again."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def frugal(run):
    """A kernel of ``mapInArrow`` whose worker keeps nothing of the memory that the task needed."""

    def wrapped(batches: Iterator) -> Iterator:
        _libc()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def frugal_group(run):
    """The same for a kernel of ``applyInArrow``; it is called for each group, so memory is given back only after large ones."""

    def wrapped(table: pa.Table) -> pa.Table:
        _libc()
        try:
            return run(table)
        finally:
            if table.nbytes > 1 << 20:
                give_back()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_null) of a string column; a null is an empty text. Offsets start at 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64), np.ones(len(col), bool)
    null = np.asarray(col.is_null().to_numpy(zero_copy_only=False), bool)
    if null.any():
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    width = np.int64 if wide else np.int32
    if len(col) == 0 or off is None:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64), null
    off = np.frombuffer(off, width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    return raw, off - off[0], null


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of at most ``SLICE_ROWS`` rows and ``limit`` text bytes (one row at least)."""
    col = batch.column(batch.schema.get_field_index(text))
    _, off, _ = buffers(col)
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n, at + SLICE_ROWS)
        yield batch.slice(at, to - at)
        at = to


def words(raw: np.ndarray, off: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (``[^\\x20\\x09-\\x0D]+`` by default), and for each document the index of its first word (n + 1)."""
    if len(raw) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~gap[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[off] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:-1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, off)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, ASCII capitals folded when ``lower``."""
    if len(start) == 0:
        return np.empty(0, np.uint64)
    fwd, inv = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[lower][raw] * fwd[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int, short_whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each document and their document's row, in text order.

    With fewer than k words (and at least one) the whole sequence is one shingle when ``short_whole``.
    """
    n_words = np.diff(first)
    n = len(hashes)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    out = np.empty(0, np.uint64)
    row = np.empty(0, np.int64)
    if n >= k:
        acc = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            acc = acc * np.uint64(0xD6E8FEB86659FD93) + hashes[i : n - k + 1 + i]
        ok = doc[: n - k + 1] == doc[k - 1 :]
        out, row = mix(acc[ok]), doc[: n - k + 1][ok]
    if short_whole:
        few = np.flatnonzero((n_words > 0) & (n_words < k))
        if len(few):
            extra = np.zeros(len(few), np.uint64)
            for i in range(k):
                live = n_words[few] > i
                at = np.minimum(first[few] + i, max(n - 1, 0))
                extra = np.where(live, extra * np.uint64(0xD6E8FEB86659FD93) + hashes[at], extra)
            extra = mix(extra ^ (n_words[few].astype(np.uint64) << np.uint64(56)))
            out, row = np.concatenate([out, extra]), np.concatenate([row, few])
            order = np.argsort(row, kind="stable")
            out, row = out[order], row[order]
    return out, row


def distinct_per_doc(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value), sorted by row and then by value."""
    if len(values) == 0:
        return values, row
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[keep], row[keep]

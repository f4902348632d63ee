"""Token counts by heap-and-linked-list byte-pair merging.

A text is normalised and split as the vocabulary file says; each pre-token becomes a linked list of byte symbols whose
adjacent pairs wait in a heap, and the pair of lowest rank (leftmost on ties) is merged until none is left. The count is
the number of initial symbols minus the number of merges; no identifiers are made. Counts of words already met are kept
in bounded caches per Python worker.

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings of the vocabulary that occur in a text
count as one token each, as the library does by default; repeated rows are counted once each; columns other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textcore import frugal
from .tokens import LONGEST_CACHED, byte_symbols, default_path

CACHE_WORDS = 120_000
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class HeapBpe:
    """Counts tokens under a word-end BPE vocabulary file (NFC, white space dropped, lower case, byte level)."""

    def __init__(self, path: str):
        import json

        import regex

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        kinds = [s["type"] for s in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("unsupported vocabulary file")
        suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + suffix] for s in symbols]
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace("\\s", _SPACE)
        self.split = regex.compile(split)
        self.words: dict[str, int] = {}
        self.chunks = _Counts(self._chunk)

    def merges(self, data: bytes) -> int:
        """Merges done on one pre-token."""
        n = len(data)
        sym = [self.inner[b] for b in data]
        sym[-1] = self.last[data[-1]]
        nxt = list(range(1, n)) + [-1]
        prv = list(range(-1, n - 1))
        ranks, heap = self.ranks, []
        for i in range(n - 1):
            got = ranks.get(sym[i] << 32 | sym[i + 1])
            if got:
                heap.append((got[0], i, got[1], i + 1))
        heapify(heap)
        done = 0
        while heap:
            rank, i, new, j = heappop(heap)
            if sym[i] < 0 or nxt[i] != j or ranks.get(sym[i] << 32 | sym[j], (-1,))[0] != rank:
                continue
            done += 1
            sym[i], sym[j] = new, -1
            k = nxt[i] = nxt[j]
            if k >= 0:
                prv[k] = i
                got = ranks.get(new << 32 | sym[k])
                if got:
                    heappush(heap, (got[0], i, got[1], k))
            h = prv[i]
            if h >= 0:
                got = ranks.get(sym[h] << 32 | new)
                if got:
                    heappush(heap, (got[0], h, got[1], i))
        return done

    def _word(self, word: str) -> int:
        got = self.words.get(word)
        if got is None:
            data = word.encode("utf-8")
            got = len(data) - self.merges(data)
            if len(word) <= LONGEST_CACHED:
                if len(self.words) >= CACHE_WORDS:
                    self.words.clear()
                self.words[word] = got
        return got

    def _plain(self, text: str) -> int:
        if text.isascii():
            text = text.lower()
        else:
            text = "".join(c.lower() for c in unicodedata.normalize("NFC", text))
        return sum(map(self._word, self.split.findall(text)))

    def _chunk(self, chunk: str) -> int:
        if self.special is None or not self.special.search(chunk):
            return self._plain(chunk)
        return sum(map(self._plain, self.special.split(chunk))) + len(self.special.findall(chunk))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        for c in "\n\t\r":
            if c in text:
                text = text.replace(c, " ")
        return sum(map(self.chunks.__getitem__, filter(None, text.split(" "))))


class _Counts(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk):
        out = self.make(chunk)
        if len(chunk) <= LONGEST_CACHED:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[chunk] = out
        return out


_LOADED: dict[str, HeapBpe] = {}


def _loaded(path: str) -> HeapBpe:
    if path not in _LOADED:
        _LOADED[path] = HeapBpe(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row."""
    path = path or default_path()
    src = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    schema = T.StructType([src.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .textcore import slices

        bpe = _loaded(path)
        for batch in batches:
            for part in slices(batch, "text"):
                counts = pa.array([bpe.count(t) for t in part.column(2).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), counts], names=schema.names)

    return src.mapInArrow(frugal(run), schema)

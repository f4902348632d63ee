"""Token ids of whole texts by a public tokenizer library, with repeated words encoded once.

The vocabulary's normaliser and splitter treat each white-space separated chunk on its own (white space is dropped, no
rule looks across it), so ids of a text are the ids of its chunks in order. Chunks are encoded by the library itself;
a bounded cache per Python worker holds the ids of chunks already met. A word of letters is handed to the vocabulary's own model
directly; the library's normaliser and splitter would leave it whole.
"""

from __future__ import annotations

import os
import sys
from array import array

#: Chunks held in one worker, about 200 bytes each; two generations of half as many.
CACHE_CHUNKS = 600_000
LONGEST_CACHED = 48
#: Up to here letters and their lower case are the same in every version of Unicode, and no letter composes with another.
_STABLE = "\u024f"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class _Cache(dict):
    """Ids of chunks. When the young half is full it becomes the old one, so chunks that are met again stay."""

    def __init__(self, tok, plain: bool):
        super().__init__()
        self.encode, self.plain = tok.encode, plain
        self.model = tok.model
        self.table = dict(enumerate(byte_symbols()))
        self.old: dict[str, bytes] = {}

    def __missing__(self, chunk):
        out = self.old.get(chunk)
        if out is None:
            out = self._ids(chunk)
        if len(chunk) <= LONGEST_CACHED:
            if len(self) >= CACHE_CHUNKS // 2:
                self.old = dict(self)
                self.clear()
            self[chunk] = out
        return out

    def _ids(self, chunk: str) -> bytes:
        if self.plain:
            # letters and the punctuation after them are split apart, and case is folded, before any id is chosen
            bare = chunk.rstrip(",.")
            if bare.isalpha() and (bare.isascii() or max(bare) <= _STABLE):
                low = bare.lower()
                if not low.isalpha():
                    pass
                elif len(bare) < len(chunk):
                    return self[low] + self[chunk[len(bare) :]]
                elif low != chunk:
                    return self[low]
                else:  # one word: the vocabulary's own model, without the steps before it that leave the word as it is
                    if not low.isascii():
                        low = low.encode().decode("latin-1").translate(self.table)
                    return array("I", [t.id for t in self.model.tokenize(low)]).tobytes()
        return array("I", self.encode(chunk, add_special_tokens=False).ids).tobytes()


class ChunkTokenizer:
    """``ids(text)``: little-endian unsigned 32-bit ids, no special tokens added, nothing truncated or padded."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        self.by_chunk = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} for s in steps) and not any(
            any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", [])
        )
        split = str((spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex", ""))
        plain = {"type": "Lowercase"} in steps and split.endswith("[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
        self.cache = _Cache(tok, self.by_chunk and plain)
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are written as native unsigned 32-bit integers, which must be little-endian")

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_chunk:
            return self.cache._ids(text)
        for c in "\n\t\r":
            if c in text:
                text = text.replace(c, " ")
        return b"".join(map(self.cache.__getitem__, filter(None, text.split(" "))))


_LOADED: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """One per Python worker and path."""
    if path not in _LOADED:
        _LOADED[path] = ChunkTokenizer(path)
    return _LOADED[path]

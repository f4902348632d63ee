"""Toxicity of deobfuscated text.

Suspicious tokens (look-alike signs with or without letters, stretched letters, letters set apart by spaces or signs) become character
lattices: each sign may stand for itself or for the letters it resembles, a stretched letter for one or two, a separator and a sign at the
token's end for nothing. In a token without letters digits are most likely digits; digits alone are a number and not decoded. A noisy channel prices these readings and a byte 4-gram language model of the corpus prices the text that results; Viterbi finds the
cheapest restored text. Tokens and runs of any length are decoded whole, and the lexicon is looked up at every position of a restored run
of set-apart letters, which does not tell where its words part. Words of restored text are then weighed by the log-odds of their toxic and clean document frequencies
(the whole word or its first letters), and a logistic fit turns the sum over distinct words into a score.

The language model is counted over all rows that are not held out, and keeps every gram: it is broadcast as sorted arrays of 8 bytes for each
different 4-gram, so it grows with the variety of the text. Labels come from a bounded sample: of each class the ``max_rows``
labelled, not held out ids with the smallest hash. Every stem of theirs that is evidence enough is in the lexicon.

Defined results: null and empty texts have no evidence and get the fitted floor; without labelled documents of both classes every score is
the share of toxic ones (0 without labels); null ids are not held out and not learned from; of several labels of an id the highest
counts; repeated rows each get a row; other columns are ignored; texts of any length are scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .langid import Trees, _rows, held_out
from .ngrams import gram_counts
from .runtime import discard, materialise
from .textcore import frugal

#: Letters that signs are used for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h", "%": "o",
}
_SEPARATORS = "._-*~'`^/\\"
_EDGE = "\"'.,;:?)]}>»”"
_SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+*])(?:[ .\-_*~](?:[^\W_]|[@$!|+*])){2,}(?!\w)")
_STRETCH = re.compile(r"(\w)\1\1")
_SIGN = re.compile(r"[0-9@$!|+(<€£*#%._\-~'`^/\\]")
_LETTER = re.compile(r"[^\W\d_]")
_PARTED = re.compile(r"[\s.\-_*~]+")
#: Bits that reading a sign at a token's end as nothing costs: marks that close a sentence are common there, others are not.
_CLOSING = {"!": 1.0, "*": 1.0, "&": 1.0, "#": 4.0, "%": 4.0, "$": 9.0}
CACHE_TOKENS = 400_000
CACHE_GRAMS = 400_000


class Restorer:
    """Viterbi decoding of character lattices under a byte 4-gram model."""

    def __init__(self, trees: Trees):
        self.trees = trees
        self.cache: dict[int, float] = {}

    def _bits(self, context: bytes, byte: int) -> float:
        import numpy as np

        gram = int.from_bytes(context, "big") << 8 | byte
        got = self.cache.get(gram)
        if got is None:
            got = float(self.trees.bits(np.array([gram], np.uint32), 4)[0, 0]) if self.trees.languages else 8.0
            if len(self.cache) >= CACHE_GRAMS:
                self.cache.clear()
            self.cache[gram] = got
        return got

    @staticmethod
    def lattice(token: str) -> list[list[tuple[str, float]]]:
        """For each slot the readings and their channel costs in bits."""
        slots: list[list[tuple[str, float]]] = []
        i, n = 0, len(token)
        end = len(token.rstrip("".join(_CLOSING)))
        lettered = bool(_LETTER.search(token))
        while i < n:
            c, j = token[i], i
            while j < n and token[j] == c:
                j += 1
            run = j - i
            if _LETTER.match(c):
                if run >= 3:
                    slots.append([(c, 1.0), (c * 2, 1.5)])
                elif run == 2:
                    slots.append([(c * 2, 0.0), (c, 12.0)])
                else:
                    slots.append([(c, 0.0)])
            else:
                letters = LOOKALIKES.get(c, "")
                for _ in range(1 if run >= 3 else run):
                    options = [(x, 2.0) for x in letters]
                    itself = 9.0 if options or c in _SEPARATORS or c == " " else 0.0
                    if c in _SEPARATORS or c == " ":
                        options.append(("", 1.0))
                    elif i >= end:
                        options.append(("", _CLOSING[c]))
                    if not lettered and options:
                        itself = 0.0 if c.isdigit() else 4.0
                    options.append((c, itself))
                    slots.append(options)
            i = j
        return slots

    def restore(self, token: str) -> str:
        """The cheapest reading of the whole token. All contexts are kept; readings are linked backwards, so time is linear in its length."""
        states: dict[bytes, tuple] = {b"\n\n ": (0.0, None)}
        for slot in self.lattice(token):
            nxt: dict[bytes, tuple] = {}
            for context, (cost, path) in states.items():
                for reading, price in slot:
                    c, total = context, cost + price
                    for byte in reading.encode():
                        total += self._bits(c, byte)
                        c = c[1:] + bytes([byte])
                    if c not in nxt or total < nxt[c][0]:
                        nxt[c] = (total, (path, reading) if reading else path)
            states = nxt
        path, out = min(states.items(), key=lambda x: x[1][0] + self._bits(x[0], 0x20))[1][1], []
        while path is not None:
            path, reading = path
            out.append(reading)
        return "".join(reversed(out))


def suspicious(token: str) -> bool:
    """Signs among letters, stretched letters, or no letter but signs that resemble some. Digits alone are a number."""
    if _LETTER.search(token):
        return bool(_SIGN.search(token) or _STRETCH.search(token))
    return len(token) > 1 and any(c in LOOKALIKES and not c.isdigit() for c in token)


class Reader:
    """Words of restored text."""

    def __init__(self, restorer: Restorer):
        self.restorer = restorer
        self.cache: dict[str, str] = {}

    def word(self, token: str) -> str:
        got = self.cache.get(token)
        if got is None:
            low = token.lower().strip(_EDGE)
            got = low
            if not low.isalpha() and suspicious(low) or _STRETCH.search(low):
                got = self.restorer.restore(low)
            if len(token) <= 48:
                if len(self.cache) >= CACHE_TOKENS:
                    self.cache.clear()
                self.cache[token] = got
        return got

    def spaced(self, text: str) -> list[str]:
        """Restored runs of letters that are set apart, whole and without what still parts them."""
        runs = (m[0] for m in _SPACED.finditer(text.lower()))
        return [_PARTED.sub("", self.restorer.restore(run)) for run in runs if _LETTER.search(run) or suspicious(run)]


def keys_of(word: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys((word, *(word[:k] + "~" for k in (6, 5, 4) if len(word) >= k))))


def lengths_of(keys) -> list[int]:
    """Lengths of the whole words among the keys."""
    return sorted({len(k) for k in keys if not k.endswith("~")})


def keys_within(run: str, known, lengths: list[int]) -> Iterator[list[str]]:
    """For each position of a restored run the known keys of the words that may begin there: nothing tells where its words part."""
    for i in range(len(run)):
        found = [k for n in lengths if n and i + n <= len(run) and (k := run[i : i + n]) in known]
        found += [k for n in (6, 5, 4) if i + n <= len(run) and (k := run[i : i + n] + "~") in known]
        if found:
            yield found


class Model:
    def __init__(self, trees: Trees, weights: dict[str, float], coef: tuple[float, float, float], floor: float):
        self.trees, self.weights, self.coef, self.floor = trees, weights, coef, floor
        self.reader = None

    def ready(self) -> Model:
        if self.reader is None:
            self.reader = Reader(Restorer(self.trees))
            self.cache: dict[str, str | None] = {}
            self.lengths = lengths_of(self.weights)
        return self

    def _key(self, word: str) -> str | None:
        """The weightiest lexicon entry that the word has."""
        found = [k for k in keys_of(word) if k in self.weights]
        return max(found, key=self.weights.__getitem__) if found else None

    def evidence(self, text: str | None) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        tokens, cache = text.split(), self.cache
        hits = set()
        for t in set(tokens):
            got = cache.get(t, 0)
            if got == 0:
                got = self._key(self.reader.word(t))
                if len(cache) >= CACHE_TOKENS:
                    cache.clear()
                cache[t] = got
            if got is not None:
                hits.add(got)
        for run in self.reader.spaced(text):
            hits.update(max(found, key=self.weights.__getitem__) for found in keys_within(run, self.weights, self.lengths))
        return sum(self.weights[h] for h in sorted(hits)), len(tokens)

    def score(self, text: str | None) -> float:
        import math

        if self.coef is None:
            return self.floor
        s, n = self.evidence(text)
        z = self.coef[0] + self.coef[1] * s + self.coef[2] * math.log1p(n) * (s > 0)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def logistic(x, y, ridge: float = 1e-3, steps: int = 50):
    """Ridge logistic regression by Newton steps; the classes weigh the same."""
    import numpy as np

    x = np.column_stack([np.ones(len(x)), x])
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        grad = x.T @ (w * (y - p)) - ridge * len(y) * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, least_docs: int = 4, least_odds: float = 4.5, least_z: float = 2.6) -> Model:
    import numpy as np

    spark = docs.sparkSession
    free = docs.where(~held_out())
    full = materialise(gram_counts(free, None), "charlm")
    grams = {}
    for k in (4, 3, 2, 1):
        level = full if k == 4 else full.groupBy(F.lit("").alias("label"), F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).agg(F.sum("n").alias("n"))
        grams[k] = _rows(level, [""])
    discard(full)
    trees = Trees([""] if len(grams[4]) else [], grams)

    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out())
    order = F.xxhash64("doc_id")
    sample = [marked.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(max_rows) for t in (1, 0)]
    sample = materialise(sample[0].unionByName(sample[1]), "toxic-sample")
    # at most 2 * max_rows ids
    rows = materialise(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("toxic", "text"), "toxic-rows")
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return Model(trees, {}, None, size.get(1, 0) / max(1, sum(size.values())))

    shared = spark.sparkContext.broadcast(Model(trees, {}, None, 0.0))

    def counted(wanted):
        known = spark.sparkContext.broadcast(wanted)

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            reader, wanted = shared.value.ready().reader, known.value
            lengths = lengths_of(wanted or ())
            seen: Counter = Counter()
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    words, runs = {reader.word(t) for t in set((text or "").split())}, reader.spaced(text or "")
                    if wanted is None:  # candidates: of a run only itself, and without the letter that may be a word of its own
                        seen.update({k for w in words.union(*((r, r[1:], r[:-1]) for r in runs)) for k in keys_of(w)})
                    else:
                        keys = {k for w in words for k in keys_of(w)} & wanted
                        seen.update(keys.union(*(k for r in runs for k in keys_within(r, wanted, lengths))))
                if len(seen) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["k", "n"])
                    seen = Counter()
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["k", "n"])

        return run

    def frequencies(toxic, wanted):
        return rows.where(F.col("toxic") == toxic).select("text").mapInArrow(counted(wanted), "k string, n long").groupBy("k").agg(F.sum("n").alias("n"))

    bad = {r["k"]: r["n"] for r in frequencies(1, None).where(F.col("n") >= least_docs).collect()}  # of at most max_rows texts
    good = {r["k"]: r["n"] for r in frequencies(0, set(bad)).collect()}
    odds = {k: np.log((n + 0.5) / (size[1] + 1)) - np.log((good.get(k, 0) + 0.5) / (size[0] + 1)) for k, n in bad.items() if k}
    # log-odds must stand out from chance: their standard error is that of two counts
    error = {k: np.sqrt(1 / (bad[k] + 0.5) + 1 / (good.get(k, 0) + 0.5)) for k in odds}
    best = sorted((k for k in odds if odds[k] >= max(least_odds, least_z * error[k])), key=lambda k: (-odds[k], k))
    weights = {k: float(odds[k]) for k in best}
    lexicon = spark.sparkContext.broadcast(Model(trees, weights, None, 0.0))

    def evidence(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = lexicon.value.ready()
        for batch in batches:
            got = [model.evidence(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array([n for _, n in got], pa.int64())], names=["toxic", "s", "n"])

    data = rows.select("toxic", "text").mapInArrow(evidence, "toxic int, s double, n long").toPandas()
    x = np.column_stack([data["s"], np.log1p(data["n"]) * (data["s"] > 0)])
    return Model(trees, weights, logistic(x, data["toxic"].to_numpy()), 0.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .textcore import slices

        m = shared.value.ready()
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m.score(t) for t in part.column(1).to_pylist()], pa.float64())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(frugal(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **params) -> DataFrame:
    """Learn and score: ``doc_id, held_out, score, predicted``."""
    scored = score(docs, learn(docs, labels, **params))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

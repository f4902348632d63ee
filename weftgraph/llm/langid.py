"""Language identification by prediction by partial matching.

Every learned language has a context tree over bytes of order 3. A byte that was seen after its context costs
``-log2 c / (n + d)`` bits (c: times seen there, n: times the context was seen, d: distinct bytes after it); otherwise the
escape ``-log2 d / (n + d)`` is paid and the next shorter context is tried, down to a uniform byte. The statistics are
frozen after learning, so the code length of a text is exact and independent of other texts; the language that codes
the text in the fewest bits is predicted, and the score is its posterior under equal priors.

Counts are gathered over all learning rows and every language, gram and context is kept, however many there are. The orders 1 to 3 are
broadcast whole (a byte model has at most 2^24 of their grams). The longest order is split by context into parts of about ``cells`` (gram,
language) pairs; a part holds every gram of its contexts, so its code lengths are exact, and each part takes one pass over the texts that
prices the bytes whose context falls in it. The sum over the passes is the code length. Small inputs have one part and one pass.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or when nothing was learned; texts of any
length are scored whole; ties go to the alphabetically first language; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ngrams import gram_counts
from .runtime import discard, materialise
from .textcore import frugal

ORDERS = (4, 3, 2, 1)
#: (gram, language) pairs of the longest order in one part.
CELLS = 8 << 20
_SLOTS = 22


def part_of(gram, parts: int):
    """The part that a gram of the longest order falls in: a hash of its context."""
    import numpy as np

    return ((np.asarray(gram) >> np.array(8, np.asarray(gram).dtype)).astype(np.uint64) * np.uint64(2654435761) >> np.uint64(8)) % np.uint64(parts)


def held_out() -> Column:
    """Rows whose crc32 of the id as text is 2 modulo 4; they are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Trees:
    """Frozen code lengths: for each order the known grams and their bits per language, and escapes per context."""

    def __init__(self, languages: list[str], grams: dict[int, list[tuple[int, int, int]]]):
        """``grams[k]``: (language index, gram of k bytes, count)."""
        import numpy as np

        self.languages = languages
        n_lang = len(languages)
        below = None  # (keys, bits) of the order below
        self.esc, self.tables = {}, {}
        for k in sorted(ORDERS):
            rows = np.asarray(grams.get(k, []), np.int64).reshape(-1, 3)
            keys = np.unique(rows[:, 1])
            count = np.zeros((n_lang, len(keys)))
            count[rows[:, 0], np.searchsorted(keys, rows[:, 1])] = rows[:, 2]
            context = keys >> 8
            ctx, at = np.unique(context, return_inverse=True)
            n = np.stack([np.bincount(at, weights=c, minlength=len(ctx)) for c in count]) if n_lang else np.zeros((0, len(ctx)))
            d = np.stack([np.bincount(at, weights=c > 0, minlength=len(ctx)) for c in count]) if n_lang else n
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(n > 0, -np.log2(d / (n + d)), 0.0)
                hit = -np.log2(count / (n + d)[:, at])
            lower = self._lower(below, keys & ((1 << 8 * (k - 1)) - 1), n_lang, k)
            bits = np.where(count > 0, hit, escape[:, at] + lower)
            self.esc[k] = (ctx, escape.astype(np.float32))
            self.tables[k] = (keys.astype(np.uint32), bits.astype(np.float32))
            below = k
        self.index = None

    def _lower(self, below, grams, n_lang, k):
        import numpy as np

        return np.full((n_lang, len(grams)), 8.0) if k == 1 else self.bits(grams, k - 1)

    def bits(self, grams, k: int):
        """Code lengths (languages x grams) of grams of k bytes, by sorted lookup; unseen ones escape."""
        import numpy as np

        if k == 0:
            return np.full((len(self.languages), len(grams)), 8.0)
        keys, bits = self.tables[k]
        out = np.zeros((len(self.languages), len(grams)))
        at = np.minimum(np.searchsorted(keys, grams), max(len(keys) - 1, 0))
        known = keys[at] == grams if len(keys) else np.zeros(len(grams), bool)
        out[:, known] = bits[:, at[known]]
        if not known.all():
            miss = np.asarray(grams)[~known]
            ctx, escape = self.esc[k]
            c = miss >> np.array(8, miss.dtype)
            at = np.minimum(np.searchsorted(ctx, c), max(len(ctx) - 1, 0))
            seen = ctx[at] == c if len(ctx) else np.zeros(len(c), bool)
            low = self.bits(miss & np.array((1 << 8 * (k - 1)) - 1, miss.dtype), k - 1)
            low[:, seen] += escape[:, at[seen]]
            out[:, ~known] = low
        return out

    def prepare(self) -> Trees:
        """Open-addressed index of the longest order: one probe settles nearly all bytes of a text."""
        import numpy as np

        keys, bits = self.tables[max(ORDERS)]
        self.slots = max(_SLOTS, min(26, len(keys).bit_length() + 2))
        slot = (keys * np.uint32(2654435761)) >> np.uint32(32 - self.slots)
        table = np.full(1 << self.slots, len(keys), np.int32)
        table[slot] = np.arange(len(keys), dtype=np.int32)
        self.keys = np.append(keys, np.uint32(0))
        self.rows = [np.append(b, np.float32(0)) for b in bits]
        self.index = table
        return self

    def lengths(self, raw, off, part: int = 0, parts: int = 1):
        """Bits of each document under each language (documents x languages), of the bytes whose context falls in ``part``."""
        import numpy as np

        from .ngrams import codes

        grams = codes(raw, off)
        at = self.index[(grams * np.uint32(2654435761)) >> np.uint32(32 - self.slots)]
        missed = (self.keys[at] != grams) | (at == len(self.keys) - 1)
        other = part_of(grams, parts) != part if parts > 1 else None
        missed = np.flatnonzero(missed if other is None else missed & ~other)
        extra = self.bits(grams[missed], max(ORDERS)) if len(missed) else None
        out = np.zeros((len(off) - 1, len(self.languages)))
        for i, row in enumerate(self.rows):
            cost = row[at]
            if extra is not None:
                cost[missed] = extra[i]
            if other is not None:
                cost[other] = 0
            total = np.zeros(len(raw) + 1)
            np.cumsum(cost, dtype=np.float64, out=total[1:])
            out[:, i] = total[off[1:]] - total[off[:-1]]
        return out


class Parts:
    """The frozen trees of every part of the longest order; one part is built, and held by the driver, at a time."""

    def __init__(self, counts: DataFrame | None, languages: list[str], lower: dict, number: int):
        self.counts, self.languages, self.lower, self.number = counts, languages, lower, number

    def trees(self, part: int) -> Trees:
        k = max(ORDERS)
        if not self.languages:
            return Trees([], {})
        context = F.shiftrightunsigned("gram", 8)
        mine = F.shiftrightunsigned(context * F.lit(2654435761), 8) % self.number == part
        return Trees(self.languages, {**self.lower, k: _rows(self.counts.where(mine), self.languages)})


def _rows(level: DataFrame, languages: list[str]):
    """``language index, gram, count`` as an array of integers."""
    import numpy as np

    number = F.create_map(*[F.lit(y) for i, x in enumerate(languages) for y in (x, i)])
    got = level.select(number[F.col("label")].cast("long").alias("i"), F.col("gram").cast("long").alias("g"), F.col("n").cast("long").alias("n")).toArrow()
    return np.column_stack([got.column(c).to_numpy() for c in range(3)])


def learn(docs: DataFrame, cells: int = CELLS) -> Parts:
    """Frozen trees from all rows of ``docs`` with a text and a ``lang``."""
    full = materialise(gram_counts(docs, "lang"), "ppm")
    languages = sorted(r["label"] for r in full.select("label").distinct().collect())
    if not languages:
        discard(full)
        return Parts(None, [], {}, 1)
    lower = {}
    for k in ORDERS[1:]:
        level = full.groupBy("label", F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).agg(F.sum("n").alias("n"))
        lower[k] = _rows(level, languages)
    pairs = full.select("gram").distinct().count() * len(languages)
    return Parts(full, languages, lower, -(-pairs // cells))


def _has_letter(raw, off, col):
    import numpy as np

    low = raw | 0x20
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((low >= 97) & (low <= 122), out=total[1:])
    out = total[off[1:]] > total[off[:-1]]
    for i in np.flatnonzero(~out & (off[1:] > off[:-1])):
        out[i] = any(c.isalpha() for c in col[int(i)].as_py())
    return out


def _bits(docs: DataFrame, trees: Trees, part: int, parts: int, schema: T.StructType, finish) -> DataFrame:
    """``finish`` of the ids, texts and code lengths in one part, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        from .textcore import buffers, slices

        model = shared.value
        if model.index is None:
            model.prepare()
        for batch in batches:
            for piece in slices(batch, "text"):
                col = piece.column(1)
                raw, off, _ = buffers(col)
                bits = model.lengths(raw, off, part, parts) if model.languages and len(raw) else np.zeros((piece.num_rows, len(model.languages)))
                yield finish(piece, raw, off, bits)

    return docs.select("doc_id", "text").mapInArrow(frugal(run), schema)


def _verdict(bits, ok, languages: list[str]):
    """Names and scores by code lengths; ``und`` where not ``ok``."""
    import numpy as np
    import pyarrow as pa

    names = np.array([*languages, "und"], object)
    best, score = np.full(len(bits), len(languages)), np.zeros(len(bits))
    if languages:
        first = bits.argmin(axis=1)
        gap = np.minimum(bits - bits[np.arange(len(bits)), first][:, None], 1000)
        best[ok] = first[ok]
        score[ok] = (1 / np.exp2(-gap).sum(axis=1))[ok]
    return pa.array(names[best].tolist(), pa.string()), pa.array(score)


def predict(docs: DataFrame, parts: Parts) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row."""
    languages = parts.languages
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if parts.number == 1:

        def whole(piece, raw, off, bits):
            import pyarrow as pa

            return pa.RecordBatch.from_arrays([piece.column(0), *_verdict(bits, _has_letter(raw, off, piece.column(1)), languages)], names=schema.names)

        return _bits(docs, parts.trees(0), 0, 1, schema, whole)

    # equal (id, text) rows have equal sums: they are added up together, and dealt out again by their number
    summed = T.StructType(
        [docs.schema["doc_id"], *[T.StructField(n, t) for n, t in (("digest", T.BinaryType()), ("ok", T.BooleanType()), ("bits", T.ArrayType(T.DoubleType())))]]
    )

    def partial(piece, raw, off, bits):
        import hashlib

        import pyarrow as pa

        view = raw.tobytes()
        digests = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        ok = _has_letter(raw, off, piece.column(1))
        return pa.RecordBatch.from_arrays([piece.column(0), pa.array(digests, pa.binary()), pa.array(ok.tolist(), pa.bool_()), pa.array(bits.tolist(), pa.list_(pa.float64()))], names=summed.names)

    passes = None
    for p in range(parts.number):
        one = _bits(docs, parts.trees(p), p, parts.number, summed, partial)
        one = materialise(one.groupBy("doc_id", "digest", "ok").agg(F.count("*").alias("rows"), F.first("bits").alias("bits")), "ppm-part")
        passes = one if passes is None else passes.unionByName(one)
    totals = passes.groupBy("doc_id", "digest", "ok").agg(F.max("rows").alias("rows"), *[F.sum(F.col("bits")[i]).alias(f"b{i}") for i in range(len(languages))])
    totals = totals.select("doc_id", "ok", F.array(*[f"b{i}" for i in range(len(languages))]).alias("bits"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_"))

    def judge(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            bits = batch.column(2).flatten().to_numpy().reshape(-1, len(languages))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_verdict(bits, np.asarray(batch.column(1).to_pylist(), bool), languages)], names=schema.names)

    return totals.drop("_").mapInArrow(judge, schema)


def identify(docs: DataFrame, **params) -> DataFrame:
    """Learn from the rows that are not held out and predict all rows: ``doc_id, held_out, lang_pred, score``."""
    parts = learn(docs.where(~held_out()), **params)
    out = predict(docs, parts)
    discard(parts.counts)  # every part has been read
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

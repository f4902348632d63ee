"""Importance resampling of a corpus towards a target distribution, by hashed n-gram features.

A document's features are all runs of one to ``max_n`` consecutive words, each hashed into one of ``n_buckets`` buckets. A bucket's *gain* is the
smoothed log ratio of its share in the target to its share in the corpus; a document's weight is its mean gain. Gumbel noise that depends on the
id alone turns the highest ``share`` percent of the scores into a draw without replacement, in proportion to ``exp(weight / 1000)``.

Nothing but DataFrame functions. Features are never exploded for scoring: higher-order functions make a document's array of buckets and fold it
over ``element_at`` of one literal array of gains. The counting pass explodes buckets (integers) into a partial aggregation, so that a task hands on
``n_buckets`` totals at most, however skewed words, documents or sources are. The texts are read twice and never shuffled or stored.

Ranks need no global sort: documents are counted by score (an integer; the noise spreads even equal texts over thousands of values, none of which
has more than 1 / (1000 e) of them), the counts of higher scores come from a running sum over the distinct scores, and only drawn rows are ordered,
score by score.

Defined results: a null or wordless text has no feature and weight 0; a null ``doc_id`` hashes like the empty string and comes last among ties; repeated
rows are rows of their own, with equal scores and ranks that follow one another; columns other than ``doc_id`` and ``text`` are ignored; an empty table gives an
empty result, an empty target counts as one of no features. A row takes some twenty times its text in memory while it is scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import discard, materialise

N_BUCKETS = 10_000
_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased: what stands between ASCII characters that are no letter or digit."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _CAPITALS, _SMALL), _GAP), lambda w: w != "")


def bucket_array(ws: Column, n_buckets: int = N_BUCKETS, max_n: int = 2) -> Column:
    """Buckets of all runs of one to ``max_n`` words, repeats included; ``ws`` must be a plain column, as it is looked at several times."""
    hashed = lambda w: (F.crc32(w.cast("binary")) % n_buckets).cast("int")
    runs = [F.transform(ws, hashed)]
    for n in range(2, max_n + 1):
        left = F.greatest(F.size(ws) - (n - 1), F.lit(0))
        grams = F.slice(ws, F.lit(1), left)
        for k in range(1, n):
            grams = F.zip_with(grams, F.slice(ws, F.lit(k + 1), left), lambda a, b: F.concat(a, F.lit(" "), b))
        runs.append(F.transform(grams, hashed))
    return F.concat(*runs) if len(runs) > 1 else runs[0]


def bucketed(docs: DataFrame, n_buckets: int = N_BUCKETS, max_n: int = 2) -> DataFrame:
    """``doc_id, n_words, buckets`` of every row."""
    ws = docs.select("doc_id", words(F.col("text")).alias("ws"))
    return ws.select("doc_id", F.size("ws").alias("n_words"), bucket_array(F.col("ws"), n_buckets, max_n).alias("buckets"))


def bucket_totals(texts: DataFrame, n_buckets: int = N_BUCKETS, max_n: int = 2) -> DataFrame:
    """``bucket, n``: features of all rows by bucket."""
    rows = bucketed(texts.select(F.lit(None).alias("doc_id"), "text"), n_buckets, max_n)
    # outer: before a plain explode the optimiser puts a filter on the array's size, pushed down to where it splits each text several times more
    return rows.select(F.explode_outer("buckets").alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n_buckets: int = N_BUCKETS, max_n: int = 2) -> DataFrame:
    """``bucket, gain`` of every bucket: 1000 times the smoothed log ratio of the target's share to the corpus's, floored."""
    every = docs.sparkSession.range(n_buckets).select(F.col("id").cast("int").alias("bucket"))
    counted = bucket_totals(docs, n_buckets, max_n).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        bucket_totals(target, n_buckets, max_n).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    )
    counted = counted.unionByName(every.select("bucket", F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    counted = counted.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    # both sums over all buckets, which are n_buckets rows
    whole = Window.partitionBy(F.lit(0))
    counted = counted.withColumn("all_s", F.sum("s").over(whole)).withColumn("all_t", F.sum("t").over(whole))
    double = lambda c, more: (F.col(c) + more).cast("double")
    ratio = double("t", 1) * double("all_s", n_buckets) / (double("s", 1) * double("all_t", n_buckets))
    return counted.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def gain_array(table: DataFrame, n_buckets: int = N_BUCKETS) -> Column:
    """The gains as one literal array; the optimiser folds it once."""
    by_bucket = dict(table.select("bucket", "gain").collect())  # n_buckets rows
    return F.split(F.lit(",".join(str(by_bucket[b]) for b in range(n_buckets))), ",").cast("array<bigint>")


def floored_mean(total: Column, n: Column) -> Column:
    """Floor of ``total / n`` in integers, 0 where there is nothing to average."""
    n = F.when(n > 0, n)
    return F.coalesce(((total - F.pmod(total, n)) / n).cast("long"), F.lit(0).cast("long"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """1000 times standard Gumbel noise, floored: a function of seed and id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weights(docs: DataFrame, gain: Column, n_buckets: int = N_BUCKETS, max_n: int = 2, seed: int = 7) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row."""
    zero = F.lit(0).cast("long")
    rows = bucketed(docs, n_buckets, max_n).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("buckets").cast("long").alias("n_features"),
        F.aggregate("buckets", zero, lambda total, b: total + F.element_at(gain, b + 1)).alias("total"),
    )
    rows = rows.select("doc_id", "n_words", "n_features", floored_mean(F.col("total"), F.col("n_features")).alias("weight"))
    return rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def ranked(scored: DataFrame, share: int = 25, min_words: int = 20) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... for the highest ``share`` percent of the rows with ``min_words`` words, null for the others."""
    able = F.col("n_words") >= min_words
    by_score = scored.where(able).groupBy("score").agg(F.count("*").alias("own"))
    # a few ten thousand distinct scores: gains and noise span a few ten thousandths each
    up = Window.partitionBy(F.lit(0)).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    by_score = by_score.select("score", "own", F.coalesce(F.sum("own").over(up), F.lit(0)).alias("above"), F.sum("own").over(Window.partitionBy(F.lit(0))).alias("n_able"))
    reached = by_score.select("score", "above", F.expr(f"n_able * {int(share)} div 100").alias("n_drawn")).where("above < n_drawn")
    drawn = scored.where(able).join(F.broadcast(reached), "score")
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"))
    drawn = drawn.withColumn("rank", F.col("above") + F.row_number().over(order))
    rank = F.when(F.col("rank") <= F.col("n_drawn"), F.col("rank")).cast("long").alias("rank")
    rest = scored.join(F.broadcast(reached.select(F.col("score").alias("_reached"))), able & (F.col("score") == F.col("_reached")), "left_anti")
    return drawn.select(*scored.columns, rank).unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, share: int = 25, min_words: int = 20, n_buckets: int = N_BUCKETS, max_n: int = 2, seed: int = 7) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row."""
    table = materialise(gains(docs, target, n_buckets, max_n), "gains", light=True)
    gain = gain_array(table, n_buckets)
    discard(table)
    scored = materialise(weights(docs, gain, n_buckets, max_n, seed), "scores")
    return ranked(scored, share, min_words)


def draw(docs: DataFrame, target: DataFrame, share: int = 25, min_words: int = 20, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is drawn, all columns; of repeated rows all stay if one is drawn."""
    picked = resample(docs, target, share, min_words, seed=seed).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(picked, docs["doc_id"].eqNullSafe(F.col("_drawn")), "left_semi")

"""Quality rules: word statistics and robust multivariate outliers, in DataFrame functions only.

Base statistics are computed inside the row (no shuffle of words). The verdict is a minimum-covariance-determinant (MCD) estimate per
language and source, of the rows that pass the base rules:

1. Four starts (medians with diagonal scales, hyperbolic-tangent correlations, spatial signs, the central half) each take two concentration
   steps: the ``support`` share of rows with the smallest Mahalanobis distances gives the next mean and covariance.
2. The start of least determinant in each group goes on until its determinant falls no more.
3. The estimate is scaled to the whole by the consistency factor of ``support`` under chi-square, and made again from all rows within the
   0.975 quantile. A row whose distance is beyond the chi-square quantile of 1 - ``tail`` is rejected.

The covariance is regularised by ``FLOOR`` on its diagonal, as a statistic that is constant in clean text has no variance there. All per-group
state is a mergeable aggregate: sums, products, and counts on a fixed grid, from which medians and the size of the central share follow alike
for every partitioning; a group holding a third of the rows is reduced on the map side.

Defined results: null or empty text has no words and fails the base rule; null language or source is a group of its own; a group of fewer than
``min_group`` base-passing rows uses the estimate pooled over the small groups of its language, and if that is too small as well its rows are
kept; repeated rows count as often as they occur; columns other than ``doc_id, text, lang, source`` are ignored; an empty table gives an
empty result. The words of a text are an array in its row, so a row needs some ten times the memory of its text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialise

_WS = "[\\x20\\x09-\\x0D]+"
_WS_CHARS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Components of the transformed vector.
DIMS = ("v_len", "v_sym", "v_dup", "v_rep")
#: Smallest standard deviation that counts for a component. Duplicate lines and repeated words are plain shares (a logarithm would
#: press a third and the whole together).
FLOOR = {"v_len": 0.05, "v_sym": 0.35, "v_dup": 0.06, "v_rep": 0.05}
STARTS = ("mad", "tanh", "sign", "half")
#: Steps of the grids of values, and of the logarithm of distances.
GRID, LOG_GRID = 1024, 64
#: Up to so many ids (8 bytes each) of rejected rows are broadcast.
BROADCAST_IDS = 1_000_000


def chi2_cdf(x: float, dof: int) -> float:
    """Chi-square distribution of an even number of degrees of freedom."""
    if x <= 0:
        return 0.0
    term, total = 1.0, 1.0
    for j in range(1, dof // 2):
        term *= x / 2 / j
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(tail: float, dof: int) -> float:
    """Where the upper tail of chi-square is ``tail``."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        term, total = 1.0, 1.0
        for j in range(1, dof // 2):
            term *= mid / 2 / j
            total += term
        low, high = (mid, high) if math.exp(-mid / 2) * total > tail else (low, mid)
    return (low + high) / 2


def consistency(share: float) -> float:
    """What the covariance of the central ``share`` of normal rows is multiplied by to be that of all."""
    return share / chi2_cdf(chi2_quantile(1 - share, len(DIMS)), len(DIMS) + 2)


def text_stats(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines`` per row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.length(F.translate(text, _WS_CHARS, ""))
    a = docs.select(
        "doc_id",
        "lang",
        "source",
        bare.cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _WS_CHARS, "")) > 0).alias("_lines"),
        F.when(bare == 0, F.array().cast("array<string>")).otherwise(F.split(F.btrim(text, F.lit(_WS_CHARS)), _WS)).alias("_words"),
    ).withColumn("_w", F.transform("_words", lambda x: F.xxhash64(x)))
    b = a.select(
        "doc_id",
        "lang",
        "source",
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_w").cast("long").alias("n_words"),
        F.when(
            F.size("_w") > 3,
            F.transform(
                F.sequence(F.lit(0), F.size("_w") - 3),
                lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)),
            ),
        ).alias("_t"),
    )
    # only rows with a repeated window are sorted; neighbours in (hash, position) order tell which windows repeat
    c = b.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_t")) < F.size("_t"),
            F.sort_array(F.transform("_t", lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
        ),
    ).drop("_t")
    repeated = F.transform(
        "_s",
        lambda s, i: F.when((s["h"] == F.get("_s", i - 1)["h"]) | (s["h"] == F.get("_s", i + 1)["h"]), s["p"]),
    )
    e = c.withColumn("_p", F.sort_array(F.array_compact(repeated))).drop("_s")
    cover = F.aggregate(
        F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3))).cast("long")),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x,
    )
    return e.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0).cast("long"))).drop("_p")


def _with_vector(stats: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return stats.select(
        "*",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words).alias("v_len"),
        F.log1p(F.lit(1000.0) * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("v_sym"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("v_dup"),
        (F.col("n_repeat_words") / words).alias("v_rep"),
    )


def _pairs() -> list[tuple[str, str]]:
    return [(x, y) for i, x in enumerate(DIMS) for y in DIMS[: i + 1]]


def _attach(rows: DataFrame, params: DataFrame, small: bool) -> DataFrame:
    """Join per-group parameters; broadcast only when the counted number of groups is small. Else rows of groups with over a thousandth of all rows are split off,
    of which there are fewer than a thousand, and only the others are shuffled."""
    if small:
        return rows.join(F.broadcast(params), "unit", "left")
    hot = rows.groupBy("unit").agg(F.count("*").alias("_n")).where(F.col("_n") > rows.count() // 1000).select("unit")
    hot = materialise(hot, "quality-hot", light=True)
    own = rows.join(F.broadcast(hot), "unit", "left_semi").join(F.broadcast(params.join(hot, "unit", "left_semi")), "unit", "left")
    return own.unionByName(rows.join(F.broadcast(hot), "unit", "left_anti").join(params, "unit", "left"))


def _cuts(rows: DataFrame, bins: dict[str, Column], share: float) -> DataFrame:
    """``unit`` and for each name the least bin up to which ``share`` of the unit's rows lie."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), b.cast("long").alias("bin")) for k, b in bins.items()])).alias("e")
    counts = rows.select("unit", each).groupBy("unit", "e.k", "e.bin").agg(F.count("*").alias("c"))
    w = Window.partitionBy("unit", "k")
    run = F.sum("c").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.withColumn("run", run).withColumn("total", F.sum("c").over(w)).where(F.col("run") >= F.ceil(F.col("total") * share))
    return counts.groupBy("unit").agg(*[F.min(F.when(F.col("k") == k, F.col("bin"))).alias(k) for k in bins])


def _factors(params: DataFrame, starts, scale: float = 1.0) -> DataFrame:
    """``m_*`` and the Cholesky factors ``l_*`` of the scaled and regularised ``c_*``, with the logarithm ``det_*`` of their determinant."""
    for i, x in enumerate(DIMS):
        for j, y in enumerate(DIMS[: i + 1]):
            new = {}
            for k in starts:
                rest = F.lit(scale) * F.col(f"c_{k}_{x}_{y}") + F.lit(FLOOR[x] ** 2 if x == y else 0.0)
                for z in DIMS[:j]:
                    rest = rest - F.col(f"l_{k}_{x}_{z}") * F.col(f"l_{k}_{y}_{z}")
                new[f"l_{k}_{x}_{y}"] = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{k}_{y}_{y}")
            params = params.withColumns(new)
    keep = ["unit", "n"]
    for k in starts:
        det = sum((2 * F.log(f"l_{k}_{x}_{x}") for x in DIMS), F.lit(0.0)).alias(f"det_{k}")
        keep += [*[f"m_{k}_{x}" for x in DIMS], *[f"l_{k}_{x}_{y}" for x, y in _pairs()], det]
    return params.select(*keep)


def _distances(rows: DataFrame, starts) -> DataFrame:
    """Adds ``d_*``: squared Mahalanobis distances by forward substitution."""
    for i, x in enumerate(DIMS):
        new = {}
        for k in starts:
            rest = F.col(x) - F.col(f"m_{k}_{x}")
            for z in DIMS[:i]:
                rest = rest - F.col(f"l_{k}_{x}_{z}") * F.col(f"z_{k}_{z}")
            new[f"z_{k}_{x}"] = rest / F.col(f"l_{k}_{x}_{x}")
        rows = rows.withColumns(new)
    return rows.withColumns({f"d_{k}": sum((F.col(f"z_{k}_{x}") * F.col(f"z_{k}_{x}") for x in DIMS), F.lit(0.0)) for k in starts})


def _moments(rows: DataFrame, within: dict[str, Column]) -> DataFrame:
    """``unit, n`` and for each name mean ``m_*`` and covariance ``c_*`` of the rows within."""
    aggs = [F.count("*").alias("n")]
    for k, ok in within.items():
        own = {x: F.when(ok, F.col(x)) for x in DIMS}
        aggs += [*[F.avg(own[x]).alias(f"m_{k}_{x}") for x in DIMS], *[F.covar_pop(own[x], own[y]).alias(f"c_{k}_{x}_{y}") for x, y in _pairs()]]
    return rows.groupBy("unit").agg(*aggs)


def _starts(points: DataFrame, small: bool) -> DataFrame:
    """Mean and covariance of every start, from medians and median deviations."""
    grid = {x: F.floor(F.col(x) * GRID) for x in DIMS}
    mid = _cuts(points, grid, 0.5).select("unit", *[((F.col(x) + 0.5) / GRID).alias(f"med_{x}") for x in DIMS])
    near = _attach(points, mid, small)
    off = _cuts(near, {x: F.floor(F.abs(F.col(x) - F.col(f"med_{x}")) * GRID) for x in DIMS}, 0.5)
    scale = [F.sqrt(F.pow(1.4826 * (F.col(x) + 0.5) / GRID, 2) + F.lit(FLOOR[x] ** 2)).alias(f"s_{x}") for x in DIMS]
    scales = materialise(off.select("unit", *scale).join(mid, "unit"), "quality-scale", light=True)
    z = _attach(points, scales, small)
    z = z.withColumns({f"z_{x}": (F.col(x) - F.col(f"med_{x}")) / F.col(f"s_{x}") for x in DIMS})
    z = z.withColumn("norm", sum((F.col(f"z_{x}") * F.col(f"z_{x}") for x in DIMS), F.lit(0.0)))
    half = _cuts(z, {"half": _log_bin("norm")}, 0.5)
    z = _attach(z, half, small)
    tanh, sign = {x: F.tanh(f"z_{x}") for x in DIMS}, {x: F.when(F.col("norm") > 0, F.col(f"z_{x}") / F.sqrt("norm")).otherwise(0.0) for x in DIMS}
    central = {x: F.when(_log_bin("norm") <= F.col("half"), F.col(x)) for x in DIMS}
    aggs = [F.count("*").alias("n"), *[F.first(c).alias(c) for x in DIMS for c in (f"med_{x}", f"s_{x}")], *[F.avg(central[x]).alias(f"m_half_{x}") for x in DIMS]]
    for x, y in _pairs():
        aggs += [F.covar_pop(tanh[x], tanh[y]).alias(f"t_{x}_{y}"), F.avg(sign[x] * sign[y]).alias(f"u_{x}_{y}"), F.covar_pop(central[x], central[y]).alias(f"c_half_{x}_{y}")]
    out = z.groupBy("unit").agg(*aggs)
    for x in DIMS:
        out = out.withColumns({f"m_{k}_{x}": F.col(f"med_{x}") for k in ("mad", "tanh", "sign")})
    for x, y in _pairs():
        size = F.col(f"s_{x}") * F.col(f"s_{y}")
        shape = lambda c, x=x, y=y: F.coalesce(0.9 * F.col(f"{c}_{x}_{y}") / F.nullif(F.sqrt(F.col(f"{c}_{x}_{x}") * F.col(f"{c}_{y}_{y}")), F.lit(0.0)), F.lit(0.0))
        out = out.withColumn(f"c_mad_{x}_{y}", size if x == y else F.lit(0.0))
        out = out.withColumns({f"c_tanh_{x}_{y}": size if x == y else shape("t") * size, f"c_sign_{x}_{y}": size if x == y else shape("u") * size})
    return out


def _log_bin(d) -> Column:
    return F.floor(F.log2(F.col(d) + F.lit(1e-9)) * LOG_GRID)


def estimate(points: DataFrame, support: float = 0.75, broadcast_units: int = 5000, max_steps: int = 30) -> DataFrame:
    """Reweighted MCD of each ``unit`` of ``points(unit, *DIMS)``: ``unit, n, m_*, l_*, det_*`` under the name ``mcd``."""
    small = points.select("unit").distinct().count() <= broadcast_units

    def step(params: DataFrame, starts) -> DataFrame:
        near = _distances(_attach(points, params, small), starts).select("unit", *DIMS, *[_log_bin(f"d_{k}").alias(f"b_{k}") for k in starts])
        cuts = _cuts(near, {f"q_{k}": F.col(f"b_{k}") for k in starts}, support)
        near = _attach(near, cuts if small else materialise(cuts, "quality-cut", light=True), small)
        return materialise(_moments(near, {k: F.col(f"b_{k}") <= F.col(f"q_{k}") for k in starts}), "quality-step", light=True)

    params = _factors(_starts(points, small), STARTS)
    params = materialise(params, "quality-start", light=True)
    for _ in range(2):
        moments = step(params, STARTS)
        params = _factors(moments, STARTS)
    # the start of least determinant goes on alone
    least = F.array_min(F.array(*[F.struct(F.col(f"det_{k}").alias("det"), F.lit(i).alias("i")) for i, k in enumerate(STARTS)]))["i"]
    best = moments.join(params.select("unit", least.alias("i")), "unit")
    pick = lambda c: F.coalesce(*[F.when(F.col("i") == i, F.col(c.format(k))) for i, k in enumerate(STARTS)])
    names = [*[(f"m_{{}}_{x}", f"m_mcd_{x}") for x in DIMS], *[(f"c_{{}}_{x}_{y}", f"c_mcd_{x}_{y}") for x, y in _pairs()]]
    moments = materialise(best.select("unit", "n", *[pick(a).alias(b) for a, b in names]), "quality-best", light=True)
    for _ in range(max_steps):
        before = _factors(moments, ["mcd"])
        now = step(before, ["mcd"])
        falls = before.select("unit", F.col("det_mcd").alias("was")).join(_factors(now, ["mcd"]).select("unit", F.col("det_mcd").alias("is")), "unit")
        falls = materialise(falls.where("`is` < was - 1e-9").select("unit"), "quality-falls", light=True)
        if falls.isEmpty():
            break
        # a group that has settled keeps its estimate
        moments = now.join(F.broadcast(falls) if small else falls, "unit", "left_semi").unionByName(moments.join(F.broadcast(falls) if small else falls, "unit", "left_anti"))
        moments = materialise(moments, "quality-best", light=True)
    raw = materialise(_factors(moments, ["mcd"], consistency(support)), "quality-raw", light=True)
    near = _distances(_attach(points, raw, small), ["mcd"])
    final = _moments(near, {"mcd": F.col("d_mcd") <= chi2_quantile(0.025, len(DIMS))})
    return materialise(_factors(final, ["mcd"], consistency(0.975)), "quality-final", light=True)


def quality_rules(docs: DataFrame, support: float = 0.75, tail: float = 1e-12, min_group: int = 40, broadcast_units: int = 5000) -> DataFrame:
    """One row per input row: the base statistics, ``base_failed``, ``distance2`` (squared, robust) and ``kept``.

    ``tail``: the share of normal rows that a group of clean text may lose; small, as the tails of clean text are longer than normal ones.
    """
    rows = materialise(_with_vector(text_stats(docs.select("doc_id", "text", "lang", "source"))), "quality")
    named = lambda *cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    rows = rows.withColumn("group", named("lang", "source")).withColumn("pool", named("lang"))
    good = rows.where(~F.col("base_failed"))
    sizes = materialise(good.groupBy(F.col("group").alias("unit")).agg(F.count("*").alias("g")), "quality-groups", light=True)
    base = _attach(rows.withColumn("unit", F.col("group")), sizes, sizes.count() <= broadcast_units)
    base = base.withColumn("unit", F.when(F.col("g") >= min_group, F.col("group")).otherwise(F.col("pool"))).drop("g", "group", "pool")
    points = materialise(base.where(~F.col("base_failed")).select("unit", *DIMS), "quality-points")
    params = estimate(points, support, broadcast_units)
    scored = _distances(_attach(base, params, params.count() <= broadcast_units), ["mcd"])
    judged = F.coalesce(F.col("n") >= min_group, F.lit(False))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(judged, F.col("d_mcd")).alias("distance2"),
        (~F.col("base_failed") & (~judged | F.coalesce(F.col("d_mcd") <= chi2_quantile(tail, len(DIMS)), F.lit(True)))).alias("kept"),
    )


def keep_good(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that are kept, columns unchanged. Rows are matched by ``doc_id`` (null ids by equality of nulls)."""
    gone = quality_rules(docs, **params).groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept").select("doc_id")
    gone = materialise(gone, "rejected", light=True)
    # the ids that go are fewer than those that stay: up to a counted number no text is shuffled
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = docs.alias("d").join(gone.alias("g"), F.expr("d.doc_id <=> g.doc_id"), "left_anti")
    return kept.select(*[F.col(f"d.`{c}`") for c in docs.columns])

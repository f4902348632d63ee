"""Resampling, substring dedup and the divergence audit against plain programs, edge cases included."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from weftgraph.llm import divergence, resample, substring_dedup
from weftgraph.llm.runtime import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket long, n long, term string, start long, unit string, rank int"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, tiny and long texts, ties, repeated rows, one id on two texts, and columns named like the operators' own."""
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("aeioustrn") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    base, long, shared = prose(130), prose(420), prose(75)
    texts = [None, "", " \n\t ", "one", "one two", "One  TWO", base, base, base.upper(), base.replace(" ", "\n", 5), base + " extra tail words", prose(80) + " " + shared, shared + " " + prose(90)]
    texts += [long, "x" * 5000, "héllo wörld " * 60, "naïve\x00byte\x0b", "a\n" * 300, "a " * 170, long[:900] + " " + prose(40) + " " + long[900:], "日本語 " * 80, shared, prose(20) + " " + shared + " " + shared]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6], rows[13], (None, base, "en", "s1", 1), (3, shared, "en", "s2", 1), (99, "...", "xx", "bare", 3), (98, None, "xx", "none", 0)]
    return spark.createDataFrame([(*r, 7, 8, "k", 1, "u", 5) for r in rows], DOCS)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


# ---- 11 resampling ---------------------------------------------------------------------------------------------------------


def features(text, n):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return len(ws), [zlib.crc32(" ".join(ws[i : i + k]).encode()) for k in range(1, n + 1) for i in range(len(ws) - k + 1)]


def drawn(rows, target, share, min_words, buckets, n, seed):
    mine = [(d, *features(t, n)) for d, t in rows]
    s = collections.Counter(h % buckets for _, _, fs in mine for h in fs)
    t = collections.Counter(h % buckets for text in target for h in features(text, n)[1])
    S, T = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for d, words, fs in mine:
        weight = sum(gain[h % buckets] for h in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = [(*r, i + 1 if i < share * len(able) // 100 else None) for i, r in enumerate(able)]
    return collections.Counter([*ranks, *((*r, None) for r in out if r[1] < min_words)])


@pytest.mark.parametrize(("share", "min_words", "buckets", "n", "seed"), [(25, 20, 10_000, 2, 7), (60, 1, 50, 3, 1), (100, 0, 10, 1, 2), (0, 20, 100, 2, 3)])
def test_resampling(spark, odd, share, min_words, buckets, n, seed):
    target = ["one two héllo", None, "", "wörld héllo one " * 5]
    bench = spark.createDataFrame([(i, t, 3) for i, t in enumerate(target)], "item_id long, text string, bucket int")
    got = resample.resample(odd, bench, share, min_words, buckets, n, seed)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    want = drawn([(r["doc_id"], r["text"]) for r in odd.collect()], target, share, min_words, buckets, n, seed)
    assert collections.Counter(tuple(r) for r in got.collect()) == want


def test_resampling_edges(spark, odd, empty):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert resample.resample(empty, bench).count() == 0
    none = bench.where("false")
    want = drawn([(r["doc_id"], r["text"]) for r in odd.collect()], [], 25, 20, 10_000, 2, 7)
    assert collections.Counter(tuple(r) for r in resample.resample(odd, none).collect()) == want
    picked = resample.draw(odd, bench, share=50)
    assert picked.columns == odd.columns
    assert 0 < picked.count() < odd.count()


def test_scores_are_not_exploded_and_texts_not_shuffled(odd):
    gain = resample.gain_array(odd.sparkSession.range(10_000).selectExpr("cast(id as int) as bucket", "id as gain"))
    plan = resample.weights(odd, gain)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan and "Python" not in plan
    assert "split(0,1," not in plan.lower()  # the gains are one folded literal


def test_draw_follows_the_target(spark):
    """Texts like the target are drawn far more often than others."""
    rnd = random.Random(2)
    like = lambda vocab: " ".join(rnd.choice(vocab) for _ in range(60))
    one, two = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, like(one if i % 4 == 0 else two)) for i in range(800)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, like(one)) for i in range(50)], "item_id long, text string")
    got = [r["doc_id"] for r in resample.draw(docs, bench, share=20).collect()]
    assert len(got) == 160 and sum(d % 4 == 0 for d in got) >= 140


# ---- 12 substring dedup ----------------------------------------------------------------------------------------------------


def kept_words(rows, length):
    """(doc_id, n_words, n_removed, digest, longest) of each row."""
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]

    def covered(size):
        low = {}
        for d, ws in split:
            if d is not None:
                for i in range(len(ws) - size + 1):
                    key = tuple(ws[i : i + size])
                    low[key] = min(low.get(key, d), d)
        return [{j for i in range(len(ws) - size + 1) if d is not None and low[tuple(ws[i : i + size])] < d for j in range(i, i + size)} for d, ws in split]

    gone, longest, size = covered(length), [None] * len(split), length
    while any(level := covered(size)):
        longest = [size if x else y for x, y in zip(level, longest, strict=True)]
        size *= 2
    digest = lambda ws, out: hashlib.sha256(" ".join(w for j, w in enumerate(ws) if j not in out).encode()).hexdigest()
    return collections.Counter((d, len(ws), len(out), digest(ws, out), far) for (d, ws), out, far in zip(split, gone, longest, strict=True))


@pytest.mark.parametrize(("length", "limit"), [(50, 10**6), (50, 0), (1, 0)])
def test_windows_of_earlier_documents_go(odd, length, limit, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BROADCAST_IDS", limit)
    docs = odd if length > 5 else odd.where("length(text) < 60")
    got = substring_dedup.removals(docs, length)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "longest"]
    rows = got.collect()
    have = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["longest"]) for r in rows)
    assert have == kept_words([(r["doc_id"], r["text"]) for r in docs.collect()], length)
    assert all(sum(s["to"] - s["from"] for s in r["spans"] or []) == r["n_removed"] for r in rows)


def test_random_passages(spark):
    """Few words, so that anchors tie and passages overlap in every way."""
    rnd = random.Random(11)
    rows = []
    for i in range(120):
        ws = [rnd.choice("abc") for _ in range(rnd.randint(0, 40))]
        if rows and rnd.random() < 0.7:
            other = rnd.choice(rows)[1].split()
            at, n = rnd.randint(0, len(other)), rnd.randint(0, 25)
            to = rnd.randint(0, len(ws))
            ws[to:to] = other[at : at + n]
        rows.append((rnd.randint(0, 90), " ".join(ws)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (9,):
        got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["longest"]) for r in substring_dedup.removals(docs, length).collect())
        assert got == kept_words(rows, length)


def test_substring_dedup_edges(odd, empty):
    assert substring_dedup.removals(empty).count() == 0
    out = substring_dedup.dedup(odd, 50)
    assert out.columns == odd.columns and out.count() == odd.count()
    by = {(r["doc_id"], r["rank"]): r for r in out.where("doc_id in (1, 7, 10)").collect()}
    assert by[7, 5]["text"] == "" and by[7, 5]["n_chars"] == 0 and by[1, 5]["text"] == ""
    assert by[10, 5]["text"] == "extra tail words"
    few = odd.where("doc_id in (3, 4)").where("length(text) < 20")
    assert [r["n_removed"] for r in substring_dedup.removals(few).collect()] == [0, 0]


def test_levels_double_until_none_survive(odd):
    sizes = [size for size, _ in substring_dedup.levels(odd, 50)]
    assert sizes == [50 * 2**i for i in range(len(sizes))] and len(sizes) >= 3


# ---- 13 divergence ---------------------------------------------------------------------------------------------------------


def audited(rows, min_docs, top):
    groups, df, langs = collections.defaultdict(collections.Counter), collections.Counter(), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        ws = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        groups[lang, source].update(ws)
        langs[lang].update(ws)
        df.update((lang, w) for w in set(ws))
    out = []
    for (lang, source), own in groups.items():
        kept = [w for w in langs[lang] if df[lang, w] >= min_docs]

        def share(c, kept=kept):
            total = sum(c[x] for x in kept)
            return {w: 1 + 1_000_000_000 * (c[w] + 1) // (total + len(kept)) for w in kept}

        p, every = share(own), share(langs[lang])
        f = lambda q, w: (p[w] - q[w]) ** 2 // q[w]  # noqa: B023, E731
        pairs = []
        for (other, item), counts in groups.items():
            if other == lang and item != source:
                q = share(counts)
                pairs.append((item, sum(f(q, w) for w in kept)))
        terms = [(w, f(every, w)) for w in kept if own[w] and p[w] > every[w]]
        for part, values in (("pair", pairs), ("term", terms)):
            values.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(values) if part == "pair" or i < top]
    return collections.Counter(out)


@pytest.mark.parametrize(("min_docs", "top"), [(3, 200), (1, 5), (2, 0), (50, 10)])
def test_divergence(odd, min_docs, top):
    got = divergence.audit(odd, min_docs, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    have = collections.Counter(tuple(r) for r in got.collect())
    assert have == audited([(r["text"], r["lang"], r["source"]) for r in odd.collect()], min_docs, top)


def test_divergence_edges(spark, odd, empty):
    assert divergence.audit(empty).count() == 0
    bare = odd.where("lang = 'xx'")
    assert sorted((r["source"], r["item"], r["value"], r["rank"]) for r in divergence.audit(bare).collect()) == [("bare", "none", 0, 1), ("none", "bare", 0, 1)]
    one = spark.createDataFrame([("a b c", None, None)] * 3, "text string, lang string, source string")
    assert divergence.audit(one).count() == 0


def test_divergence_on_tables(spark, sf):
    docs = table(spark, sf, "documents")
    have = collections.Counter(tuple(r) for r in divergence.audit(docs).collect())
    assert have == audited([(r["text"], r["lang"], r["source"]) for r in docs.collect()], 3, 200)


def test_shares_are_exact_beyond_64_bits(spark):
    rows = spark.createDataFrame([(10**12, 2 * 10**12, 10**6), (0, 0, 1), (9 * 10**17, 9 * 10**17 + 5, 7)], "n long, total long, kept long")
    for r in rows.select("*", divergence.share(rows["n"], rows["total"], rows["kept"]).alias("p")).collect():
        assert r["p"] == 1 + 1_000_000_000 * (r["n"] + 1) // (r["total"] + r["kept"])

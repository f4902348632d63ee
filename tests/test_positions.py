"""Term counts from an index of positions against counting each term by itself."""

import random

from weftgraph.operators import ranking
from weftgraph.operators.positions import apart, places


def test_places():
    rnd = random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choice("ab é") for _ in range(rnd.randrange(60))).encode()
        terms = ["".join(rnd.choice("ab é") for _ in range(rnd.randrange(6))).encode() for _ in range(8)] + [b"aaa", text]
        for t, got in zip(terms, places(text, terms), strict=True):
            assert got.tolist() == [i for i in range(len(text)) if t and text.startswith(t, i)]
            assert apart(got, len(t)) == (text.count(t) if t else 0)


def test_term_weights(spark):
    rnd = random.Random(5)
    words = ["Graph", "graph model", "art", "a", "ÉTÉ", "sΣ", "aaa", "data data"]
    docs = [(i, " ".join(rnd.choice(words + ["party", "aaaaa", "of"]) for _ in range(rnd.randrange(80)))) for i in range(40)] + [(90, None), (91, ""), (92, "ab" * 500)]
    terms = [(i, rnd.choice(words)) for i, _ in docs for _ in range(4)] + [(i, t) for i in (3, 90, 91) for t in ("", "Data Data")] + [(92, "abab"), (92, "ba" * 20), (5, None), (777, "x"), (None, "art")]
    size, overlap = 50, 20
    want = set()
    for i, name in set(terms):
        if name is None or i not in dict(docs):
            continue
        text = dict(docs)[i]
        n = 1 if text is None else 0 if not text else max(0, -(-(len(text) - size) // (size - overlap))) + 1
        pieces = [] if text is None else [text[k * (size - overlap) :][:size].lower() for k in range(n)]
        low = name.lower()
        tf = 0 if not low else None if text is None else text.lower().count(low)
        want.add((i, name, tf, sum(low in p for p in pieces), n))
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(terms, "doc_id long, name string")
    got = ranking.term_weights(t, d, size, overlap).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert ranking.term_weights(t, d.where("false"), size, overlap).count() == 0

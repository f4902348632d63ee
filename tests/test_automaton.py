"""Names in texts: the automaton and the joins against ``in``, on all pairs."""

import random

import numpy as np
import pytest

from weftgraph.operators import automaton, library


def spots(texts, strings):
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    row, which = automaton.find(automaton.build([s.encode() for s in strings]), np.frombuffer(b"".join(raw), np.uint8), off)
    return sorted(zip(row.tolist(), which.tolist(), strict=True))


@pytest.mark.parametrize("lane", [1, 3, 512])
def test_equals_contains(lane, monkeypatch):
    monkeypatch.setattr(automaton, "LANE", lane)
    monkeypatch.setattr(automaton, "LANES", 7)
    rnd = random.Random(lane)
    for _ in range(40):
        strings = list({"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 12))})
        texts = ["".join(rnd.choice("abéx") for _ in range(rnd.randint(0, 40))) for _ in range(9)]
        assert spots(texts, strings) == [(i, j) for i, t in enumerate(texts) for j, s in enumerate(strings) if s in t]


def test_nothing_to_find():
    assert spots(["abc", ""], []) == [] and spots([], ["a"]) == [] and spots(["", ""], ["a"]) == []
    assert spots(["she saw hers"], ["he", "she", "his", "hers", "e", "s"]) == [(0, 0), (0, 1), (0, 3), (0, 4), (0, 5)]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_mentions(spark, limit, monkeypatch):
    monkeypatch.setattr(library, "AUTOMATON_BYTES", limit)
    rnd = random.Random(9)
    word = lambda: "the" + "".join(rnd.choice("abcé") for _ in range(rnd.randint(0, 3)))
    texts = [(i, " ".join(word() for _ in range(rnd.randint(0, 30))).title(), rnd.choice(["s", "t"])) for i in range(60)]
    texts += [(100, None, "s"), (101, "", "s"), (102, "a", "s"), (103, "THE " * 4000 + "Zed", "t")]
    names = [(" ".join(word() for _ in range(rnd.randint(1, 2))), rnd.choice(["s", "t"])) for _ in range(40)] + [("a", "s"), ("eé", "t"), (" Zed ", "t"), ("ZED", "t"), ("", "s"), (None, "s"), ("missing name", "s")]
    frame, known = spark.createDataFrame(texts, "text_id long, text string, session_id string"), spark.createDataFrame(names, "name string, session_id string")
    low = [(n, n.strip().lower(), s) for n, s in names if n and n.strip()]
    got = {tuple(r) for r in library.concept_mentions(frame, known).collect()}
    assert got == {(i, n) for i, t, _ in texts for n, x, _ in low if t is not None and x in t.lower()}
    scoped = {tuple(r) for r in library.concept_mentions(frame, known, ["session_id"]).collect()}
    assert scoped == {(i, n) for i, t, a in texts for n, x, b in low if t is not None and a == b and x in t.lower()}
    assert library.concept_mentions(frame, known.where("false")).count() == 0 and library.concept_mentions(frame.where("false"), known).count() == 0

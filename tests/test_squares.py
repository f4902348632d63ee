"""Phrases that follow themselves, against all pairs of neighbouring phrases."""

import random
import time

import numpy as np

from weftgraph.functions import cleaning, squares


def plain(words):
    n = len(words)
    return any(words[i : i + p] == words[i + p : i + 2 * p] for p in range(2, n // 2 + 1) for i in range(n - 2 * p + 1))


def found(lines):
    off = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
    return squares.with_repeated_phrase(np.array([w for x in lines for w in x], np.int64), off).tolist()


def test_equals_all_pairs(monkeypatch):
    rnd = random.Random(1)
    for round_ in range(60):
        monkeypatch.setattr(squares, "_TOGETHER", rnd.choice([1, 30, 1 << 19]))
        lines = [[rnd.randrange(rnd.choice([2, 3, 5, 40])) for _ in range(rnd.randint(0, 30))] for _ in range(40)]
        assert found(lines) == [plain(x) for x in lines]
        assert [squares.repeats_itself(x) for x in lines] == [plain(x) for x in lines]
    assert found([]) == [] and found([[], [1], [1, 1, 1]]) == [False] * 3 and found([[1, 2, 3], [1, 2, 3]]) == [False, False]


def test_long_lines():
    """100,000 words in which every pair of neighbours occurs often, without and with a long phrase that follows itself."""
    word, nxt = [0], {0: [0, 1, 2], 1: [0, 2], 2: [1]}
    while len(word) < 100_000:  # a sequence over three letters without squares
        word = [y for x in word for y in nxt[x]]
    word = word[:100_000]
    began = time.time()
    assert found([word]) == [False]
    assert found([[*range(5), *word[:30_000], *range(7, 9), *word[:30_000], *range(7, 9), 5]]) == [True]
    assert time.time() - began < 60


def test_lines_in_spark(spark):
    rows = [("the red fox the red fox", True), ("the red fox the red", False), ("a a a a", True), ("a a a", False), ("", False), (None, False), ("one two one two three", True)]
    frame = spark.createDataFrame(rows, "ws string, want boolean")
    assert all(r["want"] == r["got"] for r in frame.select("want", cleaning._repeated("ws").alias("got")).collect())

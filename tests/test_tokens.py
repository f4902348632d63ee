"""Chunks that arrive out of order, again and late, over several micro-batches and restarts."""

import random

from pyspark.sql import functions as F

from weftgraph.operators import library
from weftgraph.streaming import tokens

SCHEMA = "conv_id long, n int, chunk string"


def land(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")


def advance(spark, tmp_path, wait_ms=3_600_000):
    src = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    q = tokens.text_stream(src, f"{tmp_path}/out", f"{tmp_path}/cp", wait_ms, None)
    assert q.awaitTermination(40)
    assert q.exception() is None
    return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_shuffled_chunks_give_the_text_of_the_batch(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(c, n, f"{c}.{n} ") for c in (1, 2, 3) for n in range(rnd.randint(4, 9))]
    late, rnd_rows = rows[0], rows[1:]
    rnd.shuffle(rnd_rows)
    land(spark, tmp_path, rnd_rows[:7] + rnd_rows[:2])
    land(spark, tmp_path, rnd_rows[7:] + [(None, 0, "x"), (1, None, "x"), (2, 50, None)])
    first = advance(spark, tmp_path)
    assert all(c != 1 for c, *_ in first)  # its first chunk is missing
    land(spark, tmp_path, [late, *rnd_rows[:5]])  # the gap is filled, the rest is a replay
    pieces = advance(spark, tmp_path)
    got = {c: "".join(t for d, _, _, t in pieces if d == c) for c in (1, 2, 3)}
    for c in (1, 2, 3):
        ends = [(a, b) for d, a, b, _ in pieces if d == c]
        assert ends[0][0] == 0 and all(x[1] == y[0] for x, y in zip(ends, ends[1:], strict=False))
    turns = spark.createDataFrame([(c, 0, "assistant", "") for c in (1, 2, 3)], "conv_id long, turn int, role string, text string")
    want = library.append_chunks(turns, spark.createDataFrame(rows, SCHEMA))
    assert got == {r["conv_id"]: r["text"] for r in want.select("conv_id", "text").collect()}
    land(spark, tmp_path, rows)
    assert advance(spark, tmp_path) == pieces  # a replay of everything changes nothing


def test_a_gap_is_given_up_after_a_while(spark, tmp_path):
    land(spark, tmp_path, [(1, 0, "a"), (1, 2, "c"), (1, 3, "d")])
    assert advance(spark, tmp_path, 1) == [(1, 0, 1, "a")]
    land(spark, tmp_path, [(2, 0, "z")])
    got = advance(spark, tmp_path, 1)
    assert got == [(1, 0, 1, "a"), (1, 1, 4, "cd"), (2, 0, 1, "z")]
    land(spark, tmp_path, [(1, 1, "b"), (1, 4, "e")])
    assert advance(spark, tmp_path, 1) == sorted([*got, (1, 4, 5, "e")])
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.count("*")).first()[0] == 4

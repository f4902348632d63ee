"""Progress on a stream against the batch rule: out of order, again, late, over restarts."""

import random
from datetime import datetime, timedelta

from weftgraph.streaming import status

SCHEMA = "event_id long, doc_id string, ts timestamp, status string, progress_pct int, error string"
T0 = datetime(2024, 1, 1)


def event(i, doc, minute, state, pct, error=None):
    return (i, doc, T0 + timedelta(minutes=minute), state, pct, error)


def advance(spark, tmp_path, rows, **params):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = status.progress_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), **params)
    q = got.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(60) and q.exception() is None
    out = spark.read.schema(got.schema).parquet(f"{tmp_path}/out").collect()
    return sorted((r["event_id"], r["doc_id"], r["ts"], r["status"], r["progress_pct"], r["error"]) for r in out)


def batch(spark, rows):
    got = status.monotone_progress(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted((r["event_id"], r["doc_id"], r["ts"], r["status"], r["progress_pct"], r["error"]) for r in got)


def test_a_restarted_stream_equals_the_batch(spark, tmp_path):
    rnd = random.Random(8)
    rows = [event(i, f"d{rnd.randrange(4)}", i // 2, "processing", rnd.choice([None, *range(100)]), rnd.choice([None, "slow"])) for i in range(60)]
    parts = [rows[:30], rows[20:45], rows[45:]]  # the second brings some again
    parts[0], parts[1] = parts[0][:18] + parts[0][24:], parts[0][18:24] + parts[1]  # and some that should have come before
    rnd.shuffle(parts[0])
    rnd.shuffle(parts[1])
    seen = [advance(spark, tmp_path, p, late="10 minutes") for p in parts]
    assert set(seen[0]) < set(seen[1]) < set(seen[2])
    last = advance(spark, tmp_path, [event(999, "end", 500, "done", 1), (1000, None, T0, "x", 1, None)], late="10 minutes")
    assert last == batch(spark, rows)


def test_late_events_and_finished_jobs(spark, tmp_path):
    first = [event(1, "a", 0, "processing", 40), event(2, "a", 1, "done", 100), event(3, "b", 2, "processing", 60), event(4, "z", 30, "processing", 1)]
    want = batch(spark, first[:3])
    assert advance(spark, tmp_path, first, keep_ms=3_600_000) == want
    # too late: dropped; a finished job is forgotten an hour after its end, a running one is not
    got = advance(spark, tmp_path, [event(5, "b", 3, "processing", 99), event(6, "b", 40, "processing", 10), event(7, "z", 200, "processing", 2)], keep_ms=3_600_000)
    assert [(r[0], r[4]) for r in got] == [(1, 40), (2, 100), (3, 60), (4, 1), (6, 60)]
    got = advance(spark, tmp_path, [event(8, "a", 210, "processing", 5), event(9, "b", 211, "processing", 5), event(10, "z", 300, "processing", 3)], keep_ms=3_600_000)
    assert [(r[0], r[4]) for r in got if r[0] > 6] == [(7, 2), (8, 5), (9, 60)]

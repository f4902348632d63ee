"""Job status events: latest state, monotone progress and the streaming ingest loop."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_status(events: DataFrame) -> DataFrame:
    """``doc_id, status, progress_pct, error`` of the newest event (ties by id of the event). Works on a batch and, in update mode, on a stream."""
    newest = F.max_by(F.struct("status", "progress_pct", "error"), F.struct("ts", "event_id")).alias("e")
    return events.groupBy("doc_id").agg(newest).select("doc_id", "e.*")


def status_of(latest: DataFrame, stored: DataFrame, asked: DataFrame) -> DataFrame:
    """State of the asked documents: from the events first, from the stored documents second (``processing`` and 10 by default), else NOT_FOUND."""
    ev = latest.select("doc_id", F.col("status").alias("s1"), F.col("progress_pct").alias("p1"), "error")
    st = stored.select("doc_id", F.coalesce("status", F.lit("processing")).alias("s2"), F.coalesce("progress_pct", F.lit(10)).alias("p2"))
    got = asked.join(ev, "doc_id", "left").join(st, "doc_id", "left")
    return got.select("doc_id", F.coalesce("s1", "s2", F.lit("NOT_FOUND")).alias("status"), F.coalesce("p1", "p2").alias("progress_pct"), "error")


def monotone_progress(events: DataFrame) -> DataFrame:
    """Progress that never falls back."""
    w = Window.partitionBy("doc_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("progress_pct", F.max("progress_pct").over(w))


def progress_stream(events: DataFrame, late: str = "10 minutes", keep_ms: int = 86_400_000) -> DataFrame:
    """``doc_id, event_id, ts, status, progress_pct, error``: ``monotone_progress`` of a stream of events that come out of order.

    An event waits in its document's state until the watermark, ``late`` behind the newest event of all, has passed it; then it goes out once, in the order of ``ts`` and ``event_id``,
    with the greatest progress so far. So the rows are those of the batch, up to the watermark, as long as no event is later than that; later ones are dropped, and an
    event that comes again within the wait is one. A document whose last event says ``done`` or ``error`` is forgotten when the watermark is ``keep_ms`` past it. Rows with a null document, event or
    time are ignored; a null progress leaves the greatest as it was. State is as large as what happens within ``late``, and one number for each document not forgotten.
    """
    cols = ["event_id", "us", "status", "progress_pct", "error"]

    def run(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        top, ended, held = state.get if state.exists else (None, None, "[]")
        held = [tuple(h) for h in json.loads(held)]
        for batch in batches:
            batch = batch[cols].astype(object)
            held += list(batch.where(batch.notna(), None).itertuples(index=False, name=None))
        mark = state.getCurrentWatermarkMs() * 1000
        due, kept, seen = [], [], set()
        for row in sorted(held, key=lambda h: (h[1], h[0])):
            if (row[1], row[0]) not in seen:
                seen.add((row[1], row[0]))
                (due if row[1] <= mark else kept).append(row)
        out = []
        for event, us, status, pct, error in due:
            top = pct if top is None else top if pct is None else max(top, pct)
            ended = us if status in ("done", "error") else None
            out.append((key[0], event, us, status, top, error))
        if not kept and ended is not None and ended + keep_ms * 1000 <= mark:
            if state.exists:
                state.remove()
        else:
            state.update((None if top is None else int(top), ended, json.dumps([[int(e), int(us), s, None if p is None else int(p), x] for e, us, s, p, x in kept])))
            if kept:
                state.setTimeoutTimestamp(kept[0][1] // 1000 + 1)
            elif ended is not None:
                state.setTimeoutTimestamp(ended // 1000 + keep_ms + 1)
        if out:
            rows = pd.DataFrame(out, columns=["doc_id", *cols])
            yield rows.astype({"progress_pct": "Int64"})

    kind = events.schema["doc_id"].dataType.simpleString()
    src = events.where("doc_id is not null and event_id is not null and ts is not null").select(
        "doc_id", "ts", F.col("event_id").cast("long").alias("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("status").cast("string").alias("status"), F.col("progress_pct").cast("long").alias("progress_pct"), F.col("error").cast("string").alias("error"),
    )
    got = src.withWatermark("ts", late).groupBy("doc_id").applyInPandasWithState(
        run, f"doc_id {kind}, event_id long, us long, status string, progress_pct long, error string", "top long, ended long, held string", "append", GroupStateTimeout.EventTimeTimeout
    )
    return got.select("doc_id", "event_id", F.timestamp_micros("us").alias("ts"), "status", F.col("progress_pct").cast("int").alias("progress_pct"), "error")


def read_landing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the Parquet files that land in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def ingest_stream(landing: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, every: str = "2 seconds"):
    """Run ``handle(batch, batch_id)`` on every micro-batch; ``once`` works through what has landed and stops."""
    writer = landing.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def status_stream(events: DataFrame, sink: str, checkpoint: str, name: str | None = None):
    """Latest state as a streaming aggregate in update mode, to an in-memory table (``sink='memory'``, complete mode) or the console."""
    mode = "complete" if sink == "memory" else "update"
    w = latest_status(events).writeStream.outputMode(mode).format(sink).option("checkpointLocation", checkpoint)
    return (w.queryName(name) if name else w).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: events by type and tumbling window, late ones dropped after ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")

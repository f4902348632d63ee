"""Answers that arrive in numbered chunks, put together on a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ordered_text(chunks: DataFrame, wait_ms: int = 60_000, first: int = 0) -> DataFrame:
    """``conv_id, start, stop, text``: the chunks ``start <= n < stop`` of a conversation, joined; pieces come in order and no chunk comes twice.

    ``chunks(conv_id, n, chunk)`` is a stream; numbers begin at ``first``. A reorder buffer for each conversation holds what came before its turn. A gap is waited for ``wait_ms``
    after the conversation's last chunk; then what is held goes out without it, and a chunk that comes later still is dropped, like one that comes again. Chunks of one number differ only by
    a fault: the first counts. Rows with a null conversation, number or chunk are ignored. The buffer lasts as long as the query's checkpoint and is as large as the gaps are; of a conversation
    without gaps one number is kept.
    """

    def run(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        due, held = state.get if state.exists else (first, "{}")
        held = {int(n): c for n, c in json.loads(held).items()}
        start, out = due, []

        def flushed():
            return pd.DataFrame({"conv_id": [key[0]], "start": [start], "stop": [due], "text": ["".join(out)]})

        if state.hasTimedOut:
            for n in sorted(held):
                out.append(held[n])
                due = n + 1
            held = {}
        else:
            for batch in batches:
                for n, c in zip(batch["n"].tolist(), batch["chunk"].tolist(), strict=True):
                    if n >= due:
                        held.setdefault(int(n), c)
            while due in held:
                out.append(held.pop(due))
                due += 1
        state.update((due, json.dumps(held)))
        if held:
            state.setTimeoutDuration(wait_ms)
        if out:
            yield flushed()

    kind = chunks.schema["conv_id"].dataType.simpleString()
    src = chunks.where("conv_id is not null and n is not null and chunk is not null").select("conv_id", F.col("n").cast("long").alias("n"), F.col("chunk").cast("string").alias("chunk"))
    return src.groupBy("conv_id").applyInPandasWithState(
        run, f"conv_id {kind}, start long, stop long, text string", "due long, held string", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def text_stream(chunks: DataFrame, sink: str, checkpoint: str, wait_ms: int = 60_000, every: str | None = "2 seconds"):
    """``ordered_text`` to a folder of Parquet files; started again it goes on where it stopped. Without ``every`` one batch of what has landed is worked through."""
    writer = ordered_text(chunks, wait_ms).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(once=True)).start()

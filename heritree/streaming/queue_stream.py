"""The crawl queue as a stream: insert-ignore and status events with a state for each id; batches written by foreachBatch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "status string, priority int, retry_count int, error_message string"
OUTPUT = f"wiki_id string, {STATE}"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Events in order of seq: enqueue is ignored for a known id (no priority: 0); others set the status; errors count and leave a message."""
    now = list(state.get) if state.exists else None
    events = pd.concat(list(batches)).sort_values("seq")
    for e in events.itertuples():
        if e.event == "enqueue":
            now = now or ["pending", 0 if pd.isna(e.priority) else int(e.priority), 0, None]
            continue
        now = now or ["pending", 0, 0, None]
        now[0] = e.event
        if e.event == "error":
            now[2] += 1
            now[3] = e.message
    state.update(tuple(now))
    yield pd.DataFrame([[key[0], *now]], columns=["wiki_id", "status", "priority", "retry_count", "error_message"])


def queue_state(events: DataFrame) -> DataFrame:
    """The state of every id that a micro-batch touches. events: wiki_id, seq, event, priority, message."""
    return events.groupBy("wiki_id").applyInPandasWithState(_fold, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def latest(updates: DataFrame) -> DataFrame:
    """Of updates (with batch numbers) the last for each id."""
    rest = [c for c in updates.columns if c != "wiki_id"]
    return updates.groupBy("wiki_id").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("wiki_id", "r.*")


def run_crawl(items: DataFrame, handle: Callable[[DataFrame], DataFrame], results: str, checkpoint: str, on_batch: Callable[[int, int], None] | None = None, available_now: bool = True):
    """Streams items through handle in micro-batches; rows that handle marks with `error` are kept beside the others.

    A batch is written under its number, so a batch that is run again after a failure replaces itself. Stopping between
    batches loses nothing: the checkpoint knows what is done. on_batch gets a batch's number and rows, counted as they are
    written; `leased_queue.Progress` counts by a listener.
    """

    def each(batch: DataFrame, number: int) -> None:
        seen = Observation()
        handle(batch).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{results}/batch={number}")
        if on_batch:
            on_batch(number, seen.get["n"])

    writer = items.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

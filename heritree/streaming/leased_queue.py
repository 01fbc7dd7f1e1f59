"""The crawl queue as a stateful stream with leases, and progress by a listener.

Each id has its entry in a value state. An id that is marked processing gets a timer, its lease: if neither completion nor
an error comes before it runs out, the id is pending again, as after a crash. The state can be read as a table, which is
how the next ids of the whole queue are chosen: by a top-n of all entries, not by one task that holds them.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..sources.snapshots import export_due

ENTRY = "status string, priority int, retry_count int, error_message string, processed_at timestamp, created_at timestamp, lease_ms long"
OUTPUT = "wiki_id string, status string, priority int, retry_count int, error_message string, processed_at timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LEASE_S = 600.0


class QueueProcessor(StatefulProcessor):
    """Events in order of seq: enqueue is ignored for a known id (no priority: 0); others set the status; errors count and leave a message, which completion keeps."""

    def __init__(self, lease_s: float = LEASE_S) -> None:
        self.lease_ms = int(lease_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", ENTRY)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status, priority, retries, message, ended, created, lease = self.entry.get() or (None, 0, 0, None, None, None, None)
        for e in sorted(rows, key=lambda r: r.seq):
            if status is None:
                priority, created = e.priority or 0, e.at
            if e.event == "enqueue":
                status = status or "pending"
                continue
            status = e.event
            if status == "error":
                retries, message = retries + 1, e.message
            if status in ("error", "completed"):
                ended = e.at
        if lease is not None:
            self.handle.deleteTimer(lease)
            lease = None
        if status == "processing":
            lease = timerValues.getCurrentProcessingTimeInMs() + self.lease_ms
            self.handle.registerTimer(lease)
        self.entry.update((status, priority, retries, message, ended, created, lease))
        yield Row(wiki_id=key[0], status=status, priority=priority, retry_count=retries, error_message=message, processed_at=ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        found = self.entry.get()
        if found and found[0] == "processing":
            self.entry.update(("pending", *found[1:6], None))
            yield Row(wiki_id=key[0], status="pending", priority=found[1], retry_count=found[2], error_message=found[3], processed_at=found[4])

    def close(self) -> None:
        pass


def leased_queue(events: DataFrame, lease_s: float = LEASE_S) -> DataFrame:
    """The entry of every id that a micro-batch or the end of a lease touches. events: wiki_id, seq, event, priority, message, at.

    The session's state store must be the one of RocksDB (`use_rocksdb`).
    """
    return events.groupBy("wiki_id").transformWithState(statefulProcessor=QueueProcessor(lease_s), outputStructType=OUTPUT, outputMode="Update", timeMode="ProcessingTime")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def entries(spark: SparkSession, checkpoint: str) -> DataFrame:
    """wiki_id and entry of all ids, as the stream's state holds them after its last batch."""
    state = spark.read.format("statestore").option("stateVarName", "entry").load(checkpoint)
    return state.select(F.col("key.wiki_id").alias("wiki_id"), "value.*")


def next_pending(spark: SparkSession, checkpoint: str, n: int = 1) -> DataFrame:
    """The next n ids of the whole queue: highest priority, then oldest, then id. Their processing events go into the stream, which then leases them."""
    return entries(spark, checkpoint).where("status = 'pending'").orderBy(F.desc("priority"), F.col("created_at").asc_nulls_last(), "wiki_id").limit(n)


class Progress(StreamingQueryListener):
    """Counts the rows that streams observe under a name, and calls snapshot(done) when a threshold of export_interval has been passed, looked at every save_interval rows.

    The counts come with the micro-batches' own metrics; nothing is read again. A failing snapshot doesn't stop the stream:
    its error is kept in `errors`.
    """

    def __init__(self, name: str, snapshot: Callable[[int], None], save_interval: int = 25, export_interval: int = 500) -> None:
        super().__init__()
        self.name, self.snapshot, self.save_interval, self.export_interval = name, snapshot, save_interval, export_interval
        self.done, self.last, self.errors, self.ended = 0, 0, [], threading.Event()

    def observed(self, items: DataFrame) -> DataFrame:
        """items, whose rows this listener counts."""
        return items.observe(self.name, F.count(F.lit(1)).alias("rows"))

    def add(self, rows: int) -> None:
        for at in range(self.done + 1, self.done + rows + 1):
            if export_due(at, self.last, self.save_interval, self.export_interval):
                self.last = at
                try:
                    self.snapshot(at)
                except Exception as e:  # noqa: BLE001
                    self.errors.append(f"snapshot at {at} failed: {e}")
        self.done += rows

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None and found.rows:
            self.add(found.rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

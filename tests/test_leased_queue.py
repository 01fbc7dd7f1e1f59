"""The leased queue: the stream's entries against the batch fold, leases, the next ids, progress by a listener; closure by parts."""

import datetime
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from heritree.operators import queue
from heritree.streaming import leased_queue as lq
from heritree.streaming import queue_stream

SCHEMA = "wiki_id string, seq int, event string, priority int, message string, at timestamp"
AT = datetime.datetime(2024, 1, 1)


def event(i, seq, kind, priority=None, message=None):
    return (i, seq, kind, priority, message, AT + datetime.timedelta(seconds=seq))


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    lq.use_rocksdb(spark)
    yield spark
    spark.conf.set(key, old)


def start(spark, tmp_path, lease_s, **trigger):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))

    def keep(df, n):
        df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(str(tmp_path / f"out/n={n}"))

    return lq.leased_queue(stream, lease_s).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(**trigger).start()


def until(true, seconds=60):
    end = time.time() + seconds
    while not (out := true()) and time.time() < end:
        time.sleep(0.3)
    return out


def now(spark, tmp_path):
    parts = [str(p) for p in (tmp_path / "out").glob("n=*") if (p / "_SUCCESS").exists()]
    if not parts:
        return {}
    rows = queue_stream.latest(spark.read.schema(f"{lq.OUTPUT}, batch long").parquet(*parts)).collect()
    return {r.wiki_id: r for r in rows}


def test_entries_leases_and_the_next_ids(rocks, tmp_path):
    spark = rocks
    first = [event("A", 1, "enqueue", 2), event("B", 2, "enqueue", 5), event("C", 3, "enqueue", 5), event("A", 4, "enqueue", 9), event("A", 5, "processing"), event("A", 6, "error", message="net"), event("D", 7, "processing")]
    second = [event("A", 8, "processing"), event("A", 9, "completed"), event("D", 10, "error", message="gone"), event("E", 11, "processing")]
    write(spark, tmp_path / "events", first)
    query = start(spark, tmp_path, 4.0, processingTime="200 milliseconds")
    try:
        assert until(lambda: len(now(spark, tmp_path)) == 4)
        write(spark, tmp_path / "events", second)
        assert until(lambda: now(spark, tmp_path).get("E") is not None)
        got = now(spark, tmp_path)
        # the same as the batch fold of all status events
        fold = {r.wiki_id: r for r in queue.fold_events(spark.createDataFrame([r for r in first + second if r[2] != "enqueue"], SCHEMA)).collect()}
        for i in ("A", "D"):
            assert (got[i].status, got[i].retry_count, got[i].error_message, got[i].processed_at) == (fold[i].status, fold[i].retry_count, fold[i].error_message, fold[i].processed_at)
        assert got["A"].priority == 2 and got["A"].error_message == "net" and got["B"].status == "pending"
        # nobody ends E: its lease runs out
        assert until(lambda: now(spark, tmp_path)["E"].status == "pending")
        assert now(spark, tmp_path)["A"].status == "completed" and now(spark, tmp_path)["D"].status == "error"
    finally:
        query.stop()
        query.awaitTermination(30)
    assert [r.wiki_id for r in lq.next_pending(spark, str(tmp_path / "cp"), 2).collect()] == ["B", "C"]
    assert {r.wiki_id: r.status for r in lq.entries(spark, str(tmp_path / "cp")).collect()} == {"A": "completed", "B": "pending", "C": "pending", "D": "error", "E": "pending"}


def test_thresholds_by_a_listener(spark, tmp_path):
    spark.range(1700).select(F.concat(F.lit("P-"), "id").alias("wiki_id")).repartition(9).write.parquet(str(tmp_path / "items"))
    seen = []

    def snapshot(n):
        seen.append(n)
        if n == 1000:
            raise RuntimeError("disk full")

    progress = lq.Progress("crawled", snapshot)
    spark.streams.addListener(progress)
    try:
        items = spark.readStream.schema("wiki_id string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "items"))
        counts = []
        queue_stream.run_crawl(progress.observed(items), lambda df: df, str(tmp_path / "res"), str(tmp_path / "cp"), lambda n, c: counts.append(c)).awaitTermination()
        assert until(lambda: progress.ended.is_set() and progress.done == 1700)
    finally:
        spark.streams.removeListener(progress)
    assert seen == [500, 1000, 1500] and sum(counts) == 1700 and progress.errors == ["snapshot at 1000 failed: disk full"]


def test_closure_writes_new_ids_only(spark, tmp_path, monkeypatch):
    links = [(f"n{k}", f"n{k + 1}") for k in range(12)] + [(f"n{k}", f"n{k - 3}") for k in range(3, 12)] + [("n4", "side"), ("other", "n1"), ("n2", None), (None, "n5")]
    df = spark.createDataFrame(links, "source string, target string")
    seeds = spark.createDataFrame([("n0",), ("n0",), (None,)], "wiki_id string")
    written = []
    inner = queue.stored_rows
    monkeypatch.setattr(queue, "stored_rows", lambda d, name: written.append(inner(d, name)) or written[-1])
    for expected in (1_000_000, 8):  # a crowded filter passes everything to the exact test
        written.clear()
        found = sorted(r.wiki_id for r in queue.closure(df, seeds, expected=expected).collect())
        assert found == sorted([f"n{k}" for k in range(13)] + ["side"])
        assert [n for _, n in written] == [1] * 4 + [2] + [1] * 7 + [0]
    assert sorted(r.wiki_id for r in queue.closure(df, seeds, max_rounds=3).collect()) == ["n0", "n1", "n2", "n3"]
    assert queue.closure(df, seeds, max_rounds=0).count() == 1 and queue.closure(df, seeds.where("false")).count() == 0
    assert not list(Path(tmp_path).iterdir())

"""The crawl queue as batch operators. Statuses: pending, processing, completed, error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored, stored_rows

STATUSES = ("pending", "processing", "completed", "error")
SPOUSE, CHILD, PARENT = 1, 0, 2


def first_wins(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Of rows with equal keys the one of the smallest seq; a minimum of structs, so that hot keys shrink before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(seq, *[c for c in rest if c != seq])).alias("r")).select(*[F.col(c) if c in keys else F.col(f"r.{c}") for c in rows.columns])


def enqueue(queue: DataFrame, batch: DataFrame, in_flight: DataFrame | None = None) -> DataFrame:
    """New rows (wiki_id, priority, seq) that insert-ignore would add: not in flight, not in the queue, first of the batch."""
    if in_flight is not None:
        batch = batch.join(in_flight.select("wiki_id"), "wiki_id", "left_anti")
    return first_wins(batch, ["wiki_id"]).join(queue.select("wiki_id"), "wiki_id", "left_anti").withColumn("status", F.lit("pending"))


def dequeue(queue: DataFrame, n: int = 1) -> DataFrame:
    """The next n pending rows: highest priority (nulls first), then oldest, then id."""
    return queue.where(F.col("status") == "pending").orderBy(F.col("priority").desc_nulls_first(), F.col("created_at").asc_nulls_last(), "id").limit(n)


def enqueue_batch(queue: DataFrame, batch: DataFrame, in_flight: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What `enqueue` adds, and one row with `attempted`: all of the batch that isn't in flight, whether it was there or not."""
    tried = batch if in_flight is None else batch.join(in_flight.select("wiki_id"), "wiki_id", "left_anti")
    return enqueue(queue, tried), tried.agg(F.count("*").alias("attempted"))


def take(queue: DataFrame, n: int = 1) -> tuple[DataFrame, DataFrame]:
    """The next n rows, and the queue with these marked processing."""
    taken = dequeue(queue, n)
    ids = taken.select(F.col("id").alias("__id"))
    marked = queue.join(F.broadcast(ids), F.col("id") == F.col("__id"), "left")  # n rows
    return taken, marked.withColumn("status", F.when(F.col("__id").isNotNull(), "processing").otherwise(F.col("status"))).drop("__id")


def stats(queue: DataFrame) -> DataFrame:
    """One pass for all counts."""
    return queue.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def is_empty(queue: DataFrame) -> bool:
    return queue.where(F.col("status") == "pending").isEmpty()


def reset_processing(queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queue with processing rows pending again, and how many there were."""
    stuck = F.col("status") == "processing"
    return queue.withColumn("status", F.when(stuck, "pending").otherwise(F.col("status"))), queue.agg(F.count_if(stuck).alias("reset"))


def fold_events(events: DataFrame) -> DataFrame:
    """wiki_id, status, retry_count, error_message, processed_at after ordered events (wiki_id, seq, event, message, at).

    Errors set the message and count; completion leaves the message of an earlier error in place.
    """
    error, ended = F.col("event") == "error", F.col("event").isin("error", "completed")
    return events.groupBy("wiki_id").agg(
        F.max_by("event", "seq").alias("status"), F.count_if(error).cast("int").alias("retry_count"),
        F.max_by(F.when(error, F.col("message")), F.when(error, F.col("seq"))).alias("error_message"), F.max_by(F.when(ended, F.col("at")), F.when(ended, F.col("seq"))).alias("processed_at"),
    )


def relatives(profiles: DataFrame, with_parents: bool = False) -> DataFrame:
    """wiki_id, priority, seq of what profiles (wiki_id, seq, spouses, children, father, mother) lead to; the first occurrence fixes the priority."""
    entry = lambda c, p: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(x.alias("wiki_id"), F.lit(p).alias("priority")))
    lists: list[Column] = [entry(F.col("spouses"), SPOUSE), entry(F.col("children"), CHILD)]
    if with_parents:
        lists += [entry(F.array("father"), PARENT), entry(F.array("mother"), PARENT)]
    out = profiles.select(F.col("seq").alias("at"), F.posexplode(F.concat(*lists)).alias("nth", "e")).select("e.wiki_id", "e.priority", F.struct("at", "nth").alias("seq"))
    return first_wins(out.where(~F.col("wiki_id").isin("", "0")), ["wiki_id"])


def import_queue(entries: DataFrame, visited: DataFrame) -> DataFrame:
    """Of an import, entries (wiki_id, seq) that weren't visited stay pending; all visited are completed."""
    todo = first_wins(entries, ["wiki_id"]).join(visited.select("wiki_id"), "wiki_id", "left_anti").select("wiki_id", F.lit("pending").alias("status"))
    return todo.unionByName(visited.select("wiki_id").distinct().withColumn("status", F.lit("completed")))


def closure(links: DataFrame, seeds: DataFrame, max_rounds: int | None = None, expected: int = 1_000_000) -> DataFrame:
    """All ids that crawling reaches from the seeds over links (source, target), within max_rounds steps if given.

    Semi-naive: a round follows the last one's new ids only, and adds them as a part of its own; what was found before is
    never written again. A Bloom filter of the ids found so far (for `expected` of them; beyond that it only passes more)
    lets new ids by at once; the others are held against all parts exactly.
    """
    found = frontier = stored(seeds.select("wiki_id").where("wiki_id is not null").distinct(), "closure")
    rounds = 0
    while not frontier.isEmpty() and rounds != max_rounds:
        reached = links.join(frontier, links["source"] == frontier["wiki_id"], "left_semi").select(F.col("target").alias("wiki_id")).where("wiki_id is not null").distinct()
        new, perhaps = _sifted(reached, found, expected)
        known = found.join(perhaps, "wiki_id", "left_semi")
        frontier, n = stored_rows(new.unionByName(perhaps.join(known, "wiki_id", "left_anti")), "closure")
        rounds += 1
        if n:
            found = found.unionByName(frontier)
    return found


_BITS = 1 << 15  # of a bitmap
_BITS_AN_ID = 16


def _sifted(reached: DataFrame, found: DataFrame, expected: int) -> tuple[DataFrame, DataFrame]:
    """reached parted into ids that a Bloom filter of found doesn't know, which are new, and those that it may know.

    The filter is a few bitmaps by ranges of the ids' hashes; found is read for it and not shuffled.
    """
    bitmaps = max(1, expected * _BITS_AN_ID // _BITS)
    place = F.pmod(F.xxhash64("wiki_id"), F.lit(bitmaps * _BITS))
    at = {"range": F.floor(place / _BITS), "bit": (place % _BITS).cast("long")}
    held = found.select(*[c.alias(n) for n, c in at.items()]).groupBy("range").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    octet = F.conv(F.hex(F.substring(F.col("bitmap"), F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    known = F.coalesce(F.getbit(octet, (F.col("bit") % 8).cast("int")) == 1, F.lit(False))
    marked = reached.select("wiki_id", *[c.alias(n) for n, c in at.items()]).join(held, "range", "left").select("wiki_id", known.alias("known"))
    return marked.where("not known").select("wiki_id"), marked.where("known").select("wiki_id")


def ranked(queue: DataFrame) -> DataFrame:
    """The queue's rows with their place in its order, per status."""
    w = Window.partitionBy("status").orderBy(F.col("priority").desc_nulls_first(), F.col("created_at").asc_nulls_last(), "id")
    return queue.withColumn("place", F.row_number().over(w))

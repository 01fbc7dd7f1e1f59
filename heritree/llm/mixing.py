"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: sources by code point (null last) weigh 5, 2, 1, repeating, and share 150 % of all words; no source gives more
than twice its own words, and what it can't give is shared again by weight. The mix is made of blocks of equally many
words. Each shard of the mix has a number of blocks; highest quotients target / (2 k + 1) give every source an integer
quota of them. The method never takes a seat back when the house grows, so the quota of a shard is the difference of
two apportionments, of the blocks up to its end and up to its start. Then blocks are chosen by seed: a source's
documents stand in a seeded random order, its words in that order are cut into blocks, and the shards take their quotas
of them one after another, cyclically, from a seeded block on. A document that stretches over the end of a shard's
blocks is cut there, so each shard cuts at most two documents of a source.

Defined results: a null or blank text has size 0 and nothing is taken of it; null ids and sources are values like
others; equal rows are placed one by one, and which of them is taken is left open, as they can't be told apart; an
empty table gives no rows. One row for each source is small beside the documents and is windowed as a whole; documents
are placed by (source, piece of the seeded order), so that a source with a third of all rows is many tasks' work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_space_words, stored

#: Weights of the sources in order, repeating; what all targets add up to, as a share of all words; most times a source is used.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BLOCK_WORDS, N_SHARDS, PER_SOURCE = 1024, 8, 100


def _sized(docs: DataFrame, seed: int, carry: list[str]) -> DataFrame:
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text"))
    row = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    # rows that differ in other columns only stand in the order of these, so that reruns cut the same one
    rest = [F.col(f"`{c}`") for c in carry if c != "text"]
    tie = F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0).cast("long")
    return docs.select(*row, tie.alias("tie"), "doc_id", F.col("source").cast("string").alias("source"), n_space_words(F.col("text")).alias("size"), order.alias("order"))


def targets(sized: DataFrame) -> DataFrame:
    """source, pos, source_size, weight, target."""
    every, by_ratio = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("ratio", "pos").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("pos") % len(WEIGHTS) + 1).cast("int")).cast("double")
    before = lambda c: F.coalesce(F.sum(c).over(by_ratio), F.lit(0))
    t = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST).withColumn("ratio", F.col("cap") / F.col("weight"))
        # in the order of cap / weight the sources fill up one after another; level: words a unit of weight gets if those before are full
        .withColumn("level", (F.sum("source_size").over(every) * SHARE - before("cap")) / (F.sum("weight").over(every) - before("weight")))
        .withColumn("level", F.max("level").over(every))  # it rises up to the first source that doesn't fill up and falls after
    )
    return t.select("source", "pos", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def quotas(targets: DataFrame, block_words: int | None = None, n_shards: int = N_SHARDS) -> DataFrame:
    """targets with block (words) and quota: blocks of each source for each shard, as arrays of n_shards.

    Sainte-Lague at every shard's end: q = t (N - S / 2) / T - 1 / 2 is a lower bound of a source's seats and
    t (N + S / 2) / T + 1 / 2 an upper one, so only the seats between, about four for each source, compete by quotient.
    block_words: by default BLOCK_WORDS, or less so that the smallest target has PER_SOURCE blocks.
    """
    every = Window.partitionBy(F.lit(0))
    block = F.lit(block_words) if block_words else F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(every) / PER_SOURCE)))
    t = targets.withColumn("block", F.coalesce(block, F.lit(1)).cast("long")).withColumn("total", F.sum("target").over(every)).withColumn("n_sources", F.count("*").over(every))
    t = t.withColumn("seats", F.round(F.col("total") / F.col("block")).cast("long"))
    t = t.withColumn("house", F.explode(F.sequence(F.lit(1), F.lit(n_shards)))).withColumn("seats", F.floor(F.col("seats") * F.col("house") / n_shards))
    share = F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(0.0)
    t = t.withColumn("low", F.greatest(F.lit(0), F.floor(share * (F.col("seats") - F.col("n_sources") / 2) - 1.5)).cast("long"))
    t = t.withColumn("high", F.greatest(F.col("low"), F.ceil(share * (F.col("seats") + F.col("n_sources") / 2) + 1.5)).cast("long"))
    house = Window.partitionBy("house")
    left = F.col("seats") - F.sum("low").over(house)
    seat = t.withColumn("left", left).withColumn("k", F.explode(F.sequence("low", "high"))).withColumn("quotient", F.col("target") / (2 * F.col("k") + 1))
    won = (F.row_number().over(house.orderBy(F.desc("quotient"), "pos", "k")) <= F.col("left")) & (F.col("quotient") > 0)
    seats = (
        seat.withColumn("won", won).groupBy("source", "pos", "source_size", "target", "block", "house")
        .agg((F.min("low") + F.count_if("won")).alias("upto"))
        .withColumn("quota", F.col("upto") - F.coalesce(F.lag("upto").over(Window.partitionBy("pos").orderBy("house")), F.lit(0)))
    )
    return seats.groupBy("source", "pos", "source_size", "target", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("house", "quota"))), lambda x: x["quota"]).alias("quota"))


def _pieces(n_shards: int) -> Column:
    """What each shard takes of a document that stands `at` in its source: shard, from, to (words counted from its start).

    The source's words are passed up to three times, as the first block is anywhere and none is used more than MOST times;
    a shard takes those from the `ends` of the shard before it up to its own.
    """

    def piece(turn: Column, shard: Column) -> Column:
        here = F.col("at") + turn * F.col("source_size")
        start = F.greatest(here, F.col("first") + F.coalesce(F.get("ends", shard - 1), F.lit(0))) - here
        end = F.least(here + F.col("size"), F.col("first") + F.get("ends", shard)) - here
        return F.struct(shard.alias("shard"), start.alias("from"), end.alias("to"))

    each = F.transform(F.sequence(F.lit(0), F.lit(MOST)), lambda t: F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: piece(t, s)))
    return F.filter(F.flatten(each), lambda p: p["to"] > p["from"])


def mix(docs: DataFrame, seed: int = 42, block_words: int | None = None, n_shards: int = N_SHARDS, carry: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, pieces (array of shard, from, to: the words each shard of the mix takes), and `row` of the carried columns."""
    narrow = stored(_sized(docs, seed, []), "mix-sized")
    plan = stored(quotas(targets(narrow), block_words, n_shards), "mix-plan")
    upto = lambda k: F.aggregate(F.slice("quota", F.lit(1), k), F.lit(0).cast("long"), lambda a, q: a + q)
    ends = F.transform(F.sequence(F.lit(1), F.lit(n_shards)), lambda k: F.least(upto(k) * F.col("block"), F.col("source_size") * MOST))
    first = F.col("block") * F.pmod(F.xxhash64(F.lit(seed), F.col("pos")), F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("block"))))
    plan = plan.withColumn("ends", ends).withColumn("first", first).drop("quota", "block")
    bits = min(24, max(8, math.ceil(math.log2(max(1, narrow.count() / 4096)))))
    pieced = lambda df: df.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).withColumn("piece", F.shiftrightunsigned("order", 64 - bits))
    before = (
        pieced(narrow).groupBy("pos", "piece").agg(F.sum("size").alias("words"))
        .select("pos", "piece", F.coalesce(F.sum("words").over(Window.partitionBy("pos").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    )
    rows = pieced(_sized(docs, seed, carry) if carry else narrow)
    within = Window.partitionBy("pos", "piece").orderBy("order", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0))).join(before, ["pos", "piece"]).withColumn("at", F.col("at") + F.col("before"))
    return placed.select(*(["row"] if carry else []), "doc_id", "source", "size", "source_size", "target", _pieces(n_shards).alias("pieces"))


def mix_report(docs: DataFrame, seed: int = 42, block_words: int | None = None, n_shards: int = N_SHARDS) -> DataFrame:
    """What the mix takes of each document, with `shards`: those of the mix that take it, comma-joined."""
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["to"] - p["from"])
    shards = F.array_join(F.array_sort(F.array_distinct("pieces.shard")).cast("array<string>"), ",")
    return mix(docs, seed, block_words, n_shards).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", shards.alias("shards"))


def mixed_rows(docs: DataFrame, seed: int = 42, block_words: int | None = None, n_shards: int = N_SHARDS, shard: str | None = None) -> DataFrame:
    """The mix as rows of docs: a document once for each use, cut to the words taken where the end of a shard's blocks cuts it.

    shard: also the mix's shard of each row, in a column of that name (one of docs gives way).
    """
    m = mix(docs, seed, block_words, n_shards, carry=docs.columns).select("row", "size", F.explode("pieces").alias("p"))
    words = F.split(F.regexp_replace(F.col("row.text"), r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    cut = F.array_join(F.slice(words, (F.col("p.from") + 1).cast("int"), (F.col("p.to") - F.col("p.from")).cast("int")), " ")
    m = m.select("row", "p.shard", F.when((F.col("p.from") > 0) | (F.col("p.to") < F.col("size")), cut).alias("cut"))
    new = {"text": F.coalesce("cut", "row.text"), "n_chars": F.when(F.col("cut").isNull(), F.col("row.n_chars")).otherwise(F.char_length("cut").cast("long"))} if "n_chars" in docs.columns else {"text": F.coalesce("cut", "row.text")}
    added = [F.col("shard").alias(shard)] if shard else []
    return m.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns if c != shard], *added)

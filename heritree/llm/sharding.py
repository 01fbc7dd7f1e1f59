"""Sharding by a hypergeometric communication matrix.

A uniform shuffle of all rows into shards of exact sizes, in three steps that need no global sort: draw how many rows
each input partition sends to each shard (a random matrix whose rows add up to the partitions' counts and whose columns
to the shards' sizes), permute every partition locally and cut it by its row of the matrix, exchange, and permute each
shard again. The rows see DataFrame functions only. The driver draws one count for each partition and shard. Where these
would be more than MATRIX_CELLS, input partitions are drawn for by groups: a group's rows are permuted as one, in pieces of
its key's range, so that neither a group's size nor the number of shards bounds the tasks.

Defined results: a null text has size 16 and the checksum of no bytes; a null id is an id like any other; equal rows are
placed one by one; an empty table gives no rows; other columns pass through `carry` and never clash, as they travel in
a struct. Equal texts are not kept together: the law is exact row counts.
"""

from __future__ import annotations

import json
import math
import random
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, stored

#: Extra bytes that each row counts for besides its text.
ROW_BYTES = 16
MATRIX_CELLS = 1 << 18
LOCAL_BITS = 33  # of monotonically_increasing_id: the place within the partition


def _tail(n: float) -> float:
    """log n! less Stirling's formula, to full precision however large n is."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x without cancellation near the mean."""
    if abs(x - mean) < 0.1 * (x + mean):
        v = (x - mean) / (x + mean)
        s, term, k = (x - mean) * v, 2 * x * v, 1
        while True:
            term *= v * v
            more = s + term / (2 * k + 1)
            if more == s:
                return s
            s, k = more, k + 1
    return x * math.log(x / mean) + mean - x


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    """Log of the probability of x of n by the saddle point, exact to rounding for all sizes."""
    if x == 0:
        return n * math.log(q) if p > 0.1 else n * math.log1p(-p)
    if x == n:
        return n * math.log(p)
    tails = _tail(n) - _tail(x) - _tail(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return tails + 0.5 * (math.log(n) - math.log(2 * math.pi) - math.log(x) - math.log(n - x))


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` items taken from good + bad are good; exact inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    x = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    if draws == good + bad:
        return good
    p, q = draws / (good + bad), (good + bad - draws) / (good + bad)
    chance = math.exp(_log_binomial(x, good, p, q) + _log_binomial(draws - x, bad, p, q) - _log_binomial(draws, good + bad, p, q))
    left = right = x
    p_left = p_right = chance
    u = rng.random() - chance
    while u > 0 and (left > low or right < high):
        if right < high:
            p_right *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > low:
            p_left *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= p_left
            if u <= 0:
                return left
    return x


def communication_matrix(rows: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """matrix[p][s]: how many of partition p's rows go to shard s. Row sums are `rows`, column sums are at most one apart."""
    rng, total = random.Random(seed), sum(rows)
    left = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = []
    for n in rows:
        pool, line = sum(left), []
        for s in range(n_shards):
            k = hypergeometric(rng, left[s], pool - left[s], n)
            pool, n = pool - left[s], n - k
            left[s] -= k
            line.append(k)
        matrix.append(line)
    return matrix


def _matrix_table(spark: SparkSession, pids: list[int], matrix: list[list[int]]) -> DataFrame:
    """pid, blocks, lasts: for each shard, the end of its share of the partition's permuted rows, in blocks with their last ends."""
    lines = []
    for pid, line in zip(pids, matrix, strict=True):
        ends = list(accumulate(line))
        blocks = [ends[k : k + _block(len(line))] for k in range(0, len(line), _block(len(line)))]
        lines.append({"pid": pid, "blocks": blocks, "lasts": [b[-1] for b in blocks]})
    table = F.from_json(F.lit(json.dumps(lines)), "array<struct<pid:int,blocks:array<array<bigint>>,lasts:array<bigint>>>")
    return spark.range(1).select(F.inline(table))


def _block(n_shards: int) -> int:
    return max(1, math.isqrt(n_shards))


def _shard_of(place: Column, n_shards: int) -> Column:
    """The shard whose share holds the place: first the block, then the shard in it."""
    passed = lambda ends: F.size(F.filter(ends, lambda e: e <= place))
    return let(passed(F.col("lasts")), lambda b: b * _block(n_shards) + passed(F.get(F.col("blocks"), b))).cast("int")


def _by_groups(local: DataFrame, counts: list[tuple[int, int]], n_groups: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """local with groups of partitions for partitions: `pid` the group, `local` the place in the group's permutation; and the groups' counts.

    A group is permuted by the rows' keys; it is ranked in pieces of the keys' range, of some thousand rows each.
    """
    rows: dict[int, int] = {}
    for p, n in counts:
        rows[p % n_groups] = rows.get(p % n_groups, 0) + n
    bits = _piece_bits(max(rows.values(), default=1))
    keyed = local.withColumn("group", (F.col("pid") % n_groups).cast("int")).withColumn("piece", F.shiftrightunsigned("key", 64 - bits))
    before = _before(keyed, "group")
    place = F.row_number().over(Window.partitionBy("group", "piece").orderBy("key", "pid", "local")) - 1
    ranked = keyed.withColumn("place", place).join(before, ["group", "piece"]).withColumn("local", (F.col("place") + F.col("before")).cast("long")).withColumn("pid", F.col("group"))
    return ranked.drop("group", "piece", "place", "before"), sorted(rows.items())


def _piece_bits(rows: float) -> int:
    return min(20, max(4, math.ceil(math.log2(max(1, rows / 4096)))))


def _before(df: DataFrame, of: str) -> DataFrame:
    """of, piece, before: how many rows of the pieces before it each piece has before it."""
    sizes = df.groupBy(of, "piece").agg(F.count("*").alias("n"))
    return sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(of).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")


def shard_rows(docs: DataFrame, n_shards: int, seed: int = 42, carry: list[str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """carried columns (all by default) as struct `row`, with doc_id, size, text_crc32, shard and the slot within it, without gaps."""
    spark = docs.sparkSession
    carry = docs.columns if carry is None else carry
    key = F.xxhash64(F.lit(seed), F.col(doc_id), F.crc32(F.encode(F.col(text), "utf-8")))
    kept = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry], F.lit(0).alias("__none")).alias("row"),
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(F.col(text), "utf-8")), F.lit(0)).cast("long").alias("text_crc32"),
        key.alias("key"),
        F.spark_partition_id().alias("pid"),
    )
    # permute locally: a sort by a seeded key within the partition, then the place in it
    local = kept.sortWithinPartitions("key").withColumn("local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << LOCAL_BITS) - 1)))
    local = stored(local, "shard-local")  # its counts and its rows must agree, even after a loss
    counts = sorted((r.pid, r.n) for r in local.groupBy("pid").agg(F.count("*").alias("n")).collect())
    if len(counts) * n_shards > MATRIX_CELLS:
        local, counts = _by_groups(local, counts, max(1, MATRIX_CELLS // n_shards))
    ends = _matrix_table(spark, [p for p, _ in counts], communication_matrix([n for _, n in counts], n_shards, seed))
    sent = local.drop("key").join(ends, "pid").withColumn("shard", _shard_of(F.col("local"), n_shards))
    # permute again: by a fresh key; a shard is ranked in pieces, so that no task sorts a whole shard
    bits = _piece_bits(sum(n for _, n in counts) / n_shards)
    fresh = F.xxhash64(F.lit(seed + 1), F.col("pid"), F.col("local"))
    sent = sent.withColumn("fresh", fresh).withColumn("piece", F.shiftrightunsigned("fresh", 64 - bits)).drop("blocks", "lasts")
    before = _before(sent, "shard")
    slot = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("fresh", "pid", "local")) - 1
    return (
        sent.withColumn("slot", slot).join(before, ["shard", "piece"])
        .select("row", "doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("before")).cast("long").alias("slot"))
    )


def sharded_documents(docs: DataFrame, n_shards: int = 40, seed: int = 42) -> DataFrame:
    """A report of where each document goes, without its text."""
    out = shard_rows(docs, n_shards, seed, carry=[])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded_rows(docs: DataFrame, n_shards: int = 40, seed: int = 42) -> DataFrame:
    """The rows themselves with size, text_crc32, shard and slot; columns of those names in the input give way."""
    added: list[Column] = [F.col(c) for c in ("size", "text_crc32", "shard", "slot")]
    keep = [c for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot")]
    out = shard_rows(docs, n_shards, seed, carry=keep)
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], *added)

"""A kept index of parent edges: for either direction one table, bucketed and sorted by the end that a step starts from.

It is built once and read by every traversal after that. A traversal knows how large its next level is before it reads
it, as each edge carries the number of edges that go on from its far end:

* a small level is looked up: a filter on its ids, which prunes buckets and row groups, so a step of a few persons reads
  a few files however many edges there are;
* beyond `small` edges a level is a table, stored once and joined with the bucketed edges. Only the level is shuffled.

Paths are counted, not listed, as in `graph.walk`, whose results these are.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..storage import read_note, stored_rows, write_note

SMALL = 20_000  # edges of a level that is looked up; its ids and rows pass through the driver
_ASKED = 1_000  # ids up to which a lookup is a filter; more are a join with a table of ids, sent to the tasks
_ROWS = 2_000_000  # edges in a bucket, about
_SCHEMA = "from_id string, to_id string, n long"


@dataclass(frozen=True)
class EdgeIndex:
    """from_id, to_id, n: the edges of one direction, with the number of edges that go on from to_id; to_id is null in one row for each person, n the person's own edges."""

    spark: SparkSession
    path: str
    buckets: int

    def name(self, up: bool) -> str:
        return f"edges_{'up' if up else 'down'}_{hashlib.md5(self.path.encode()).hexdigest()[:16]}"

    def table(self, up: bool = False) -> DataFrame:
        return self.spark.table(self.name(up))


def build(persons: DataFrame, path: str, buckets: int | None = None) -> EdgeIndex:
    """Writes the index of persons (wiki_id, father_wiki_id, mother_wiki_id) to path. Parents that aren't persons are no ends; persons without an id are none."""
    spark = persons.sparkSession
    people, rows = stored_rows(persons.select("wiki_id", "father_wiki_id", "mother_wiki_id").where("wiki_id is not null"), "people")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))  # fewer would be shuffled again in joins
    index = EdgeIndex(spark, path, buckets or max(least, -(-2 * rows // _ROWS)))
    ids = people.select(F.col("wiki_id").alias("parent"))
    pairs = people.select(F.col("wiki_id").alias("child"), F.explode(F.array_distinct(F.array("father_wiki_id", "mother_wiki_id"))).alias("parent")).where("parent is not null")
    pairs = pairs.join(ids, "parent", "left_semi")
    for up, (start, end) in ((False, ("parent", "child")), (True, ("child", "parent"))):
        edges = pairs.select(F.col(start).alias("from_id"), F.col(end).alias("to_id"))
        degrees = edges.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("n"))
        own = people.select(F.col("wiki_id").alias("id")).join(degrees, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
        far = edges.join(degrees, F.col("to_id") == F.col("id"), "left").select("from_id", "to_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
        _write(far.unionByName(own.select(F.col("id").alias("from_id"), F.lit(None).cast("string").alias("to_id"), F.col("n").cast("long"))), index, up, 3 * rows)
    write_note(spark, f"{path}/manifest", {"buckets": index.buckets})
    return index


def _write(edges: DataFrame, index: EdgeIndex, up: bool, rows: int) -> None:
    # a person with very many edges is dealt to several files of its bucket
    files = max(1, min(16, rows // (index.buckets * _ROWS // 4)))
    bucket, deal = F.pmod(F.hash("from_id"), F.lit(index.buckets)), F.pmod(F.xxhash64("to_id"), F.lit(files))
    dealt = edges.repartition(index.buckets * files, bucket, deal)
    dealt.write.format("parquet").bucketBy(index.buckets, "from_id").sortBy("from_id").option("path", f"{index.path}/{'up' if up else 'down'}").saveAsTable(index.name(up))


def open_index(spark: SparkSession, path: str) -> EdgeIndex:
    """An index that was built before, perhaps by another application; FileNotFoundError without a whole one."""
    index = EdgeIndex(spark, path, read_note(spark, f"{path}/manifest")["buckets"])
    for up in (False, True):
        place = f"{path}/{'up' if up else 'down'}".replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {index.name(up)} ({_SCHEMA}) USING parquet CLUSTERED BY (from_id) SORTED BY (from_id) INTO {index.buckets} BUCKETS LOCATION '{place}'")
    return index


def kept(spark: SparkSession, name: str, persons) -> EdgeIndex:
    """This application's index of that name; persons() is asked for the table the first time only."""
    found = storage.kept(spark, "edge-index", name, lambda path: build(persons(), path))
    return found if found.spark is spark else open_index(spark, found.path)


def _local(spark: SparkSession, rows: list[tuple[str, int, int]]) -> DataFrame:
    """Rows of the driver as a relation whose size the planner knows."""
    ids, paths, depths = zip(*rows) if rows else ((), (), ())
    return spark.createDataFrame(pa.table({"wiki_id": pa.array(ids, pa.string()), "paths": pa.array(paths, pa.int64()), "tree_depth": pa.array(depths, pa.int32())}))


def steps(index: EdgeIndex, ids: list[str], up: bool = False) -> DataFrame:
    """from_id, to_id, n of the edges that start at these ids."""
    edges = index.table(up).where("to_id is not null")
    if len(ids) <= _ASKED:
        return edges.where(F.col("from_id").isin(ids))
    asked = _local(index.spark, [(i, 0, 0) for i in ids]).select(F.col("wiki_id").alias("from_id"))
    return edges.join(F.broadcast(asked), "from_id", "left_semi")  # at most `small` ids


def walk(index: EdgeIndex, seed: str, depth: int, up: bool = False, small: int = SMALL) -> DataFrame:
    """wiki_id, paths, tree_depth: how often each person stands at each depth of the recursion from the seed."""
    here = index.table(up).where((F.col("from_id") == seed) & F.col("to_id").isNull()).select("n").first()
    if here is None:
        return _local(index.spark, [])
    known, level, ahead, d = [(seed, 1, 0)], {seed: 1}, here["n"], 0
    while d < depth and 0 < ahead <= small:
        paths: dict[str, int] = {}
        degree: dict[str, int] = {}
        for e in steps(index, list(level), up).collect():  # `ahead` rows
            paths[e["to_id"]] = paths.get(e["to_id"], 0) + level[e["from_id"]]
            degree[e["to_id"]] = e["n"]
        d, level, ahead = d + 1, paths, sum(degree.values())
        known += [(i, n, d) for i, n in paths.items()]
    levels = [_local(index.spark, known)]
    if d < depth and ahead:
        edges = index.table(up).where("to_id is not null").select("from_id", "to_id")
        table = _local(index.spark, [(i, n, d) for i, n in level.items()])
        while d < depth:
            d += 1
            step = table.join(edges, F.col("wiki_id") == F.col("from_id")).groupBy(F.col("to_id").alias("wiki_id")).agg(F.sum("paths").alias("paths"))
            table, n = stored_rows(step.withColumn("tree_depth", F.lit(d)), "walk-level")
            if not n:
                break
            levels.append(table)
    return reduce(DataFrame.unionByName, levels)


def summary(index: EdgeIndex) -> DataFrame:
    """direction, persons, edges, most: what the index holds and the most edges of one person."""
    count = lambda up: index.table(up).agg(F.lit("up" if up else "down").alias("direction"), F.count_if(F.col("to_id").isNull()).alias("persons"), F.count("to_id").alias("edges"), F.max(F.when(F.col("to_id").isNull(), F.col("n"))).alias("most"))
    return count(False).unionByName(count(True))



"""Tables that are changed by key: hash buckets, a manifest for each version, and writes that touch only what changes.

A row lives in the bucket of its key's hash. A change reads and rewrites the buckets that its batch's keys fall in, into a
new folder, and then writes the next version's manifest, which says for each bucket the folder that holds it. Readers go
by the latest whole manifest, so a change that fails, or is run again after executors are lost, leaves the version before
as it was; two changes of one version can't both be written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import read_note, stored_rows, write_note
from . import ingest
from .queue import first_wins

ROWS = 1_000_000  # rows in a bucket, about


class Conflict(RuntimeError):
    """Another change has made that version."""


@dataclass(frozen=True)
class VersionedTable:
    """folders: for each bucket the folder that holds it, empty if nothing does."""

    spark: SparkSession
    path: str
    key: str
    schema: str
    version: int
    folders: tuple[str, ...]

    def bucket(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(len(self.folders))).cast("int")

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of all buckets, or of some."""
        held = [f"{self.path}/data/{f}/bucket={b}" for b, f in enumerate(self.folders) if f and (buckets is None or b in set(buckets))]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*held) if held else self.spark.createDataFrame([], self.schema)

    def get(self, *keys: str) -> DataFrame:
        """The rows of some keys, out of their buckets."""
        found = self.spark.createDataFrame([(k,) for k in keys], "k string").select(self.bucket("k").alias("b")).distinct().collect()
        return self.rows([r["b"] for r in found]).where(F.col(self.key).isin(list(keys)))


def create(df: DataFrame, path: str, key: str, buckets: int | None = None) -> VersionedTable:
    """Writes version 0. Keys should be unique; rows without one are left out."""
    there = df.where(F.col(key).isNotNull())
    n = buckets or max(1, -(-there.count() // ROWS))
    empty = VersionedTable(df.sparkSession, path, key, df._jdf.schema().toDDL().replace(" NOT NULL", ""), -1, ("",) * n)
    return _write(empty, there, range(n))


def open_table(spark: SparkSession, path: str, version: int | None = None) -> VersionedTable:
    """The latest version, or one of those that are still there."""
    whole = versions(spark, path)
    if not whole or version is not None and version not in whole:
        raise FileNotFoundError(path)
    v = whole[-1] if version is None else version
    note = read_note(spark, f"{path}/versions/{v}")
    return VersionedTable(spark, path, note["key"], note["schema"], v, tuple(note["folders"]))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{n}/_SUCCESS")))


def _write(table: VersionedTable, rows: DataFrame, buckets) -> VersionedTable:
    """The next version, whose `buckets` hold these rows and whose others are as before."""
    folder = uuid.uuid4().hex
    rows.withColumn("bucket", table.bucket(table.key)).repartition("bucket").write.partitionBy("bucket").parquet(f"{table.path}/data/{folder}")
    where = table.spark._jvm.org.apache.hadoop.fs.Path(f"{table.path}/data/{folder}")
    fs = where.getFileSystem(table.spark._jsc.hadoopConfiguration())
    written = {int(s.getPath().getName().removeprefix("bucket=")) for s in fs.listStatus(where) if s.getPath().getName().startswith("bucket=")}
    folders = [folder if b in written else "" if b in set(buckets) else f for b, f in enumerate(table.folders)]
    new = VersionedTable(table.spark, table.path, table.key, table.schema, table.version + 1, tuple(folders))
    if versions(table.spark, table.path)[-1:] > [table.version]:
        raise Conflict(f"version {new.version} of {table.path} is there already")
    note = {"key": new.key, "schema": new.schema, "folders": new.folders, "parent": table.version}
    write_note(table.spark, f"{table.path}/versions/{new.version}", note)
    return new


def _touched(table: VersionedTable, *batches: DataFrame) -> list[int]:
    """Buckets that the batches' keys fall in: at most as many as the table has."""
    ids = reduce(DataFrame.unionByName, [b.select(table.bucket(b[table.key]).alias("b")) for b in batches])
    return sorted(r["b"] for r in ids.distinct().collect())


def change(table: VersionedTable, batch: DataFrame, merged: Callable[[DataFrame], DataFrame]) -> VersionedTable:
    """The version after merged(rows of the buckets that the batch's keys fall in); the table itself where the batch is empty."""
    touched = _touched(table, batch)
    columns = [f"`{c}`" for c in table.rows([]).columns]
    return _write(table, merged(table.rows(touched)).select(*columns), touched) if touched else table


def upsert(table: VersionedTable, source: DataFrame, seq: str = "seq", merge: str = "overwrite", now: Column | None = None) -> VersionedTable:
    """The version after upserts of source in order of seq, as `ingest.upsert` has them; new rows get ids after the largest one."""
    source = source.where(F.col(table.key).isNotNull())

    def merged(rows: DataFrame) -> DataFrame:
        out = ingest.upsert(rows, source, table.key, seq, merge=merge, now=now)
        if "id" not in rows.columns:
            return out
        last = table.rows().agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).first()["last"]
        first = source.groupBy(table.key).agg(F.min(seq).alias("__first"))
        return ingest.numbered(out.join(first, table.key, "left"), "id", last, ["__first", table.key])

    return change(table, source, merged)


def insert_ignore(table: VersionedTable, batch: DataFrame, seq: str = "seq") -> tuple[VersionedTable, int]:
    """The version with the batch's rows whose key isn't there, the first of each key, and how many these are."""
    batch = batch.where(F.col(table.key).isNotNull())
    new = first_wins(batch, [table.key], seq).join(table.rows(_touched(table, batch)).select(table.key), table.key, "left_anti")
    new, n = stored_rows(new, "inserted")
    return (change(table, new, lambda rows: rows.unionByName(new.drop(*(c for c in new.columns if c not in rows.columns)), allowMissingColumns=True)) if n else table), n


def insert_ignore_locations(table: VersionedTable, keys: VersionedTable, batch: DataFrame) -> tuple[VersionedTable, VersionedTable, int]:
    """Inserts locations (raw_location, location_key, seq, ...) where neither the raw text nor a key that isn't null is there.

    keys is the second unique column as a table of its own (location_key), so both conflicts are looked up in the buckets
    of the batch.
    """
    batch = batch.where("raw_location is not null")
    bare = batch.where("location_key is not null")
    known = table.rows(_touched(table, batch)).select("raw_location"), keys.rows(_touched(keys, bare)).select("location_key")
    new, n = stored_rows(ingest.not_there(*known, batch), "inserted")
    if not n:
        return table, keys, 0
    table = change(table, new, lambda rows: rows.unionByName(new.drop(*(c for c in new.columns if c not in rows.columns)), allowMissingColumns=True))
    keyed = new.where("location_key is not null").select("location_key")
    return table, change(keys, keyed, lambda rows: rows.unionByName(keyed)), n


def delete(table: VersionedTable, keys: DataFrame) -> VersionedTable:
    """The version without the rows of these keys (a column of the key's name)."""
    return change(table, keys, lambda rows: rows.join(keys.select(table.key), table.key, "left_anti"))


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes versions but the latest `keep`, and folders that no version holds; the number of folders deleted."""
    jvm = spark._jvm.org.apache.hadoop.fs
    data = jvm.Path(f"{path}/data")
    fs = data.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = versions(spark, path)
    held = {f for v in whole[-keep:] for f in open_table(spark, path, v).folders}
    for v in whole[:-keep]:
        fs.delete(jvm.Path(f"{path}/versions/{v}"), True)
    gone = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in held]
    for p in gone:
        fs.delete(p, True)
    return len(gone)


def history(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(version, buckets that it wrote anew) of each whole version that is still there."""
    out, before = [], frozenset()
    for v in versions(spark, path):
        folders = open_table(spark, path, v).folders
        out.append((v, sum(f not in before for f in folders if f)))
        before = frozenset(folders)
    return out

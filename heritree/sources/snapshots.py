"""Snapshots of tables: export, timestamped backups, listing, safe restore, a cache that follows versions.

A snapshot is a folder with a Parquet table each and a manifest, written last, so that a folder without one is not a
snapshot. The manifest has each table's rows and checksums: sums of the rows' hashes by bucket, which don't depend on their
order or files. Restoring compares them with what it has written, so a lost, doubled or changed row is found. All files go
through Spark and its file systems.
"""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

PREFIX = "backup-"
_NAME = re.compile(re.escape(PREFIX) + r"(\d{4}-\d\d-\d\dT\d\d-\d\d-\d\d)$")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


BUCKETS = 16
_MODULUS = 1 << 64


class Damaged(ValueError):
    """A table isn't what its snapshot's manifest says."""


def _sums(df: DataFrame) -> list[Column]:
    """Aggregates: the rows, and for each bucket of rows the sum of their hashes."""
    flat = [F.to_json(f"`{c}`", {"ignoreNullFields": "false"}) if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in df.dtypes]
    # a null leaves a hash as it is: what is null is hashed too
    h = F.xxhash64(*flat, F.concat(F.lit(""), *[F.when(c.isNull(), "0").otherwise("1") for c in flat]))
    other = F.xxhash64(F.lit(1), h, *flat)
    return [F.count(F.lit(1)).alias("rows"), *[F.sum(F.when(F.pmod(other, F.lit(BUCKETS)) == k, h.cast("decimal(38,0)"))).alias(f"b{k}") for k in range(BUCKETS)]]


def _summed(found: dict) -> tuple[int, list[str]]:
    return found["rows"], [f"{int(found[f'b{k}'] or 0) % _MODULUS:016x}" for k in range(BUCKETS)]


def checksums(df: DataFrame) -> tuple[int, list[str]]:
    """Rows of df, and its checksums in hexadecimal, one a bucket: equal for equal bags of rows, in whatever order or files."""
    return _summed(df.agg(*_sums(df)).first().asDict())


def export(tables: dict[str, DataFrame], path: str) -> dict:
    """Writes the tables and returns the manifest: rows and checksums of each, as they were written, and the size in bytes."""
    spark = next(iter(tables.values())).sparkSession
    rows, sums = {}, {}
    for name, df in tables.items():
        seen = Observation()
        df.observe(seen, *_sums(df)).write.mode("overwrite").parquet(f"{path}/{name}")
        rows[name], sums[name] = _summed(seen.get)
    fs, p = _fs(spark, path)
    manifest = {"path": path, "rows": rows, "checksums": sums, "bytes": fs.getContentSummary(p).getLength(), "version": datetime.now(UTC).isoformat()}
    spark.range(1).selectExpr(f"'{json.dumps(manifest)}' AS value").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def manifest(spark: SparkSession, path: str) -> dict | None:
    if not _exists(spark, f"{path}/manifest"):
        return None
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def backup(tables: dict[str, DataFrame], folder: str, now: datetime | None = None) -> dict:
    stamp = (now or datetime.now(UTC)).strftime("%Y-%m-%dT%H-%M-%S")
    return export(tables, f"{folder}/{PREFIX}{stamp}")


def pre_crawl_backup(tables: dict[str, DataFrame], folder: str) -> tuple[dict | None, str | None]:
    """(manifest, warning): a failed backup doesn't stop a crawl."""
    try:
        return backup(tables, folder), None
    except Exception as e:  # noqa: BLE001
        return None, f"backup failed: {e}"


def backups(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(timestamp, path) of whole backups, latest first."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    found = [(m[1], f"{folder}/{n}") for n in names if (m := _NAME.match(n)) and _exists(spark, f"{folder}/{n}/manifest")]
    return sorted(found, reverse=True)


def verify(spark: SparkSession, found: dict, name: str, path: str) -> int:
    """Rows of the table at path; Damaged if it isn't the manifest's. Snapshots of older versions have counts only."""
    n, sums = checksums(spark.read.parquet(path))
    if n != found["rows"][name]:
        raise Damaged(f"{name}: {n} rows, the manifest has {found['rows'][name]}")
    wanted = found.get("checksums", {}).get(name, sums)
    if sums != wanted:
        raise Damaged(f"{name}: rows of {sum(a != b for a, b in zip(sums, wanted))} of {BUCKETS} buckets differ from the manifest")
    return n


def restore(spark: SparkSession, source: str, target: str) -> dict[str, int]:
    """target becomes a copy of the snapshot: checked first, written beside it, then swapped. The old one goes last."""
    found = manifest(spark, source)
    if found is None:
        raise FileNotFoundError(source)
    new, old = f"{target}.new", f"{target}.old"
    counts = {}
    for name, rows in found["rows"].items():
        spark.read.parquet(f"{source}/{name}").write.mode("overwrite").parquet(f"{new}/{name}")
        counts[name] = verify(spark, found, name, f"{new}/{name}")
    fs, t = _fs(spark, target)
    path = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    fs.delete(path(old), True)
    if fs.exists(t):
        fs.rename(t, path(old))
    fs.rename(path(new), t)
    fs.delete(path(old), True)
    return counts


class SnapshotCache:
    """Loads a snapshot's tables once for each version; states: checking, fetching, loading, ready."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.version, self.tables, self.states = spark, None, {}, []

    def load(self, path: str) -> dict[str, DataFrame]:
        self.states = ["checking"]
        found = manifest(self.spark, path)
        if found is None:
            raise FileNotFoundError(path)
        if self.version != (path, found["version"]) or found["rows"].get("persons", 0) == 0:
            self.clear()
            self.states.append("fetching")
            tables = {n: self.spark.read.parquet(f"{path}/{n}") for n in found["rows"]}
            self.states.append("loading")
            for n, df in tables.items():
                df.cache().createOrReplaceTempView(n)
            self.tables, self.version = tables, (path, found["version"])
        self.states.append("ready")
        return self.tables

    def clear(self) -> None:
        for n, df in self.tables.items():
            df.unpersist()
            self.spark.catalog.dropTempView(n)
        self.tables, self.version = {}, None


def export_due(done: int, last: int, save_interval: int, export_interval: int) -> bool:
    """Whether a threshold has been passed since `last` processed items, looked at every save_interval items."""
    return done % save_interval == 0 and done // export_interval > last // export_interval

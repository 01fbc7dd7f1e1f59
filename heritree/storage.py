"""Shared storage for results that loops cut their lineage with."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a folder of our own only where it is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="heritree-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_KEPT: dict[tuple[str, str, str], object] = {}


def kept(spark: SparkSession, kind: str, name: str, build):
    """What build(path) has made in this application for that kind and name, in shared storage; it is asked the first time only."""
    key = (spark.sparkContext.applicationId, kind, name)
    if key not in _KEPT:
        _KEPT[key] = build(f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}")
    return _KEPT[key]


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_note(spark: SparkSession, path: str, note: dict) -> None:
    """A small JSON document, written last: a folder without it isn't whole."""
    spark.createDataFrame([(json.dumps(note),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_note(spark: SparkSession, path: str) -> dict:
    if not exists(spark, f"{path}/_SUCCESS"):
        raise FileNotFoundError(path)
    return json.loads(spark.read.text(path).first()[0])


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table and read again: computed once, whatever becomes of executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def stored_rows(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """df stored, and its number of rows, counted as they are written."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def discard(df: DataFrame) -> None:
    """Deletes a stored table that nothing will read again."""
    spark, path = df.sparkSession, getattr(df, "stored_at", None)
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

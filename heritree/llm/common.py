"""Helpers shared by the training-data operators: shared storage, paths of code, words."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, shared_dir, stored, stored_rows  # noqa: F401  for the operators

ROOT = str(Path(__file__).resolve().parents[2])

#: Bytes of words: digits, letters (upper case lowered) and everything beyond ASCII; the rest parts words.
WORD_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def spread(df: DataFrame, *keys: str, times: int = 1, rows: int = 1 << 20) -> DataFrame:
    """df by hash of keys over as many tasks as there are `rows` when each row becomes `times`: small tables come as few files."""
    return df.repartition(max(1, -(-df.count() * times // rows)), *keys)


def ship(spark: SparkSession) -> None:
    """Lets the executors' Python workers import this package from the place where the driver has it."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), ROOT]))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable is never inlined again."""
    return F.transform(F.array(value), body)[0]


def n_space_words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")

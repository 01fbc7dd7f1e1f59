"""Snapshots are proved by content: checksums don't depend on order or files, and a changed copy is refused."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from heritree.sources import snapshots


@pytest.fixture
def tables(spark):
    persons = spark.range(500).select(F.col("id"), F.concat(F.lit("P-"), "id").alias("wiki_id"), F.when(F.col("id") % 3 > 0, "x").alias("a"), F.when(F.col("id") % 3 == 0, "x").alias("b"), F.create_map(F.lit("k"), F.col("id")).alias("m"))
    return {"persons": persons, "none": persons.where("false")}


def test_order_free(spark, tables):
    persons = tables["persons"]
    n, sums = snapshots.checksums(persons)
    assert n == 500 and snapshots.checksums(persons.repartition(7).sort(F.desc("id"))) == (n, sums)
    swapped = persons.withColumns({"a": F.when(F.col("id") == 5, F.col("b")).otherwise(F.col("a")), "b": F.when(F.col("id") == 5, F.col("a")).otherwise(F.col("b"))})
    for other in (swapped, persons.where("id <> 9").unionByName(persons.where("id = 10")), persons.withColumn("m", F.when(F.col("id") == 3, F.create_map(F.lit("k"), F.lit(99).cast("long"))).otherwise(F.col("m")))):
        assert snapshots.checksums(other)[0] == 500 and snapshots.checksums(other)[1] != sums
    # two rows swapped against two of another place don't cancel out
    assert snapshots.checksums(persons.where("id < 250").unionByName(persons.where("id < 250")))[1] != sums


def test_a_changed_value_is_refused(spark, tables, tmp_path):
    path, target = f"file://{tmp_path}/snap", f"file://{tmp_path}/live"
    made = snapshots.export(tables, path)
    assert made["checksums"]["persons"] == snapshots.checksums(tables["persons"])[1] and made["checksums"]["none"] == ["0" * 16] * 16
    assert snapshots.restore(spark, path, target) == {"persons": 500, "none": 0}
    changed = tables["persons"].withColumn("a", F.when(F.col("id") == 7, "y").otherwise(F.col("a")))
    changed.write.mode("overwrite").parquet(f"{tmp_path}/changed")
    shutil.rmtree(tmp_path / "snap/persons")
    Path(tmp_path / "changed").rename(tmp_path / "snap/persons")
    with pytest.raises(snapshots.Damaged, match="of 16 buckets"):
        snapshots.restore(spark, path, target)
    assert spark.read.parquet(f"{target}/persons").where("a = 'y'").count() == 0  # what was there stays
    tables["persons"].where("id > 0").write.mode("overwrite").parquet(f"{tmp_path}/snap/persons")
    with pytest.raises(snapshots.Damaged, match="499 rows"):
        snapshots.restore(spark, path, target)

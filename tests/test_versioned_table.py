"""Tables changed by key: what is rewritten, what a failed change leaves, and the results against one-by-one changes."""

import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from heritree.operators import ingest
from heritree.operators import versioned_table as vt

SCHEMA = "id int, wiki_id string, name string, generation int, updated_at timestamp, created_at timestamp"
NOW = datetime.datetime(2024, 5, 6, 7, 8, 9)
OLD = datetime.datetime(2020, 1, 1)


@pytest.fixture
def people(spark, tmp_path):
    rows = [(k, f"P-{k}", f"name{k}", k % 4, None, OLD) for k in range(1, 201)]
    return vt.create(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/people", "wiki_id", buckets=16)


def files(table):
    return {p for p in (Path(table.path.removeprefix("file://")) / "data").rglob("*.parquet")}


def test_one_key_rewrites_one_bucket(spark, people):
    before = files(people)
    source = spark.createDataFrame([("P-7", 1, "first"), ("P-7", 2, "last")], "wiki_id string, seq int, name string")
    after = vt.upsert(people, source, now=F.lit(NOW))
    new = files(after) - before
    assert len(new) == 1 and before <= files(after) and vt.history(spark, people.path) == [(0, 16), (1, 1)]
    row = vt.open_table(spark, people.path).get("P-7").first()
    assert (row.id, row.name, row.generation, row.updated_at, row.created_at) == (7, "last", 3, NOW, OLD)
    assert after.rows().where("updated_at is null").count() == 199
    # the version before is still there
    assert vt.open_table(spark, people.path, 0).get("P-7").first().name == "name7"


def test_new_rows_are_numbered(spark, people):
    source = spark.createDataFrame([("P-900", 30, "c"), ("P-901", 10, "a"), ("P-902", 20, "b"), ("P-901", 40, "z"), (None, 1, "no key"), ("P-1", 5, "one")], "wiki_id string, seq int, name string")
    after = vt.upsert(people, source, now=F.lit(NOW))
    found = {r.wiki_id: (r.id, r.name, r.created_at) for r in after.rows().where("id > 200 or wiki_id = 'P-1'").collect()}
    assert found == {"P-901": (201, "z", NOW), "P-902": (202, "b", NOW), "P-900": (203, "c", NOW), "P-1": (1, "one", OLD)}


def test_a_failed_change_leaves_the_old_version(spark, people):
    @F.udf("string")
    def fails(x):
        raise ValueError("lost")

    source = spark.createDataFrame([("P-7", 1, "x")], "wiki_id string, seq int, name string").withColumn("name", fails("name"))
    with pytest.raises(Exception, match="lost"):
        vt.upsert(people, source)
    again = vt.open_table(spark, people.path)
    assert again.version == 0 and again.rows().count() == 200 and again.get("P-7").first().name == "name7"
    done = vt.upsert(again, spark.createDataFrame([("P-7", 1, "x")], "wiki_id string, seq int, name string"))
    with pytest.raises(vt.Conflict):  # by one who still holds version 0
        vt.upsert(again, spark.createDataFrame([("P-8", 1, "y")], "wiki_id string, seq int, name string"))
    assert vt.open_table(spark, people.path).folders == done.folders
    assert vt.vacuum(spark, people.path) >= 1 and vt.open_table(spark, people.path).rows().count() == 200 and vt.versions(spark, people.path) == [1]


def test_insert_ignore(spark, people):
    batch = spark.createDataFrame([("P-5", "known", 1), ("Q", "first", 2), ("Q", "second", 3), (None, "n", 4)], "wiki_id string, name string, seq int")
    after, n = vt.insert_ignore(people, batch)
    assert n == 1 and after.get("Q", "P-5").select("wiki_id", "name").orderBy("wiki_id").collect() == [("P-5", "name5"), ("Q", "first")]
    same, n = vt.insert_ignore(after, batch)
    assert n == 0 and same is after
    gone = vt.delete(after, spark.createDataFrame([("Q",), ("none",)], "wiki_id string"))
    assert gone.rows().count() == 200


def one_by_one(there, batch):
    """Insert with a conflict on either column, row by row."""
    raws, keys, out = {r for r, _ in there}, {k for _, k in there if k is not None}, []
    for raw, key, _ in sorted(batch, key=lambda r: r[2]):
        if raw not in raws and key not in keys:
            out.append((raw, key))
            raws.add(raw)
            keys |= {key} - {None}
    return sorted(out, key=repr)


@pytest.mark.parametrize("versioned", [False, True])
def test_locations_one_by_one(spark, tmp_path, versioned):
    there = [("Paris", None), ("Rome", "rome"), ("Oslo", "oslo"), (".", None)]
    batch = [("Paris", "paris", 1), ("paris", "paris", 2), ("ROME", "rome", 3), ("Bern", "bern", 4), ("bern", "bern", 5), (",", None, 6), (";", None, 7), (".", None, 8), ("PARIS", "paris", 9), ("Bern", "bern", 10)]
    df = spark.createDataFrame(batch, "raw_location string, location_key string, seq int")
    base = spark.createDataFrame(there, "raw_location string, location_key string")
    if versioned:
        table = vt.create(base, f"file://{tmp_path}/places", "raw_location", buckets=4)
        keys = vt.create(base.select("location_key"), f"file://{tmp_path}/keys", "location_key", buckets=4)
        table, keys, n = vt.insert_ignore_locations(table, keys, df)
        found = [tuple(r) for r in table.rows().collect() if tuple(r) not in there]
        assert n == len(found) and sorted(r.location_key for r in keys.rows().collect()) == ["bern", "oslo", "paris", "rome"]
        assert vt.insert_ignore_locations(table, keys, df)[2] == 0
    else:
        found = [(r.raw_location, r.location_key) for r in ingest.insert_ignore_locations(base, df).collect()]
    assert sorted(found, key=repr) == one_by_one(there, batch)


def test_empty(spark, tmp_path):
    none = vt.create(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none", "wiki_id", buckets=3)
    assert none.rows().count() == 0 and none.get("P").count() == 0
    assert vt.upsert(none, spark.createDataFrame([], "wiki_id string, seq int, name string")) is none
    one = vt.upsert(none, spark.createDataFrame([("P", 1, "n")], "wiki_id string, seq int, name string"))
    assert one.rows().first().id == 1
    with pytest.raises(FileNotFoundError):
        vt.open_table(spark, f"file://{tmp_path}/nothing")

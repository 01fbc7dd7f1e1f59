"""The data source of responses: rows, fields, filters at the source, streams that resume."""

import json

import pytest
from pyspark.sql.types import StructType

from heritree.sources import profiles, response_source
from heritree.sources.response_source import Decoder, ResponseReader


@pytest.fixture
def folder(spark, tmp_path):
    response_source.register(spark)
    docs = [{"Id": k, "Name": f"N-{k}", "FirstName": None if k % 3 else "A", "IsLiving": k % 2, "Children": {"7": {"Id": 7}}, "Secret": "x"} for k in range(7)]
    (tmp_path / "in").mkdir()
    for k, d in enumerate(docs):
        (tmp_path / "in" / f"profile-{k:03}.json").write_text(json.dumps([{"profile": d}]))
    (tmp_path / "in" / "ancestors-000.json").write_text(json.dumps([{"ancestors": [docs[1], docs[2], "odd", None]}]))
    (tmp_path / "in" / "profile-900.json").write_text("[{}]")
    (tmp_path / "in" / "profile-901.json").write_text("not json")
    (tmp_path / "in" / "profile-902.json").write_text("")
    return tmp_path


def test_rows(spark, folder):
    df = spark.read.format("responses").option("filesPerPartition", "2").schema("file string, kind string, nth int, Id int, Name string, IsLiving boolean, Children string").load(str(folder / "in"))
    rows = sorted(map(tuple, df.collect()))
    assert len(rows) == 9 and df.rdd.getNumPartitions() == 6
    assert rows[0][:5] == ("ancestors-000.json", "ancestors", 0, 1, "N-1") and rows[1][2] == 1 and rows[0][6] is None  # ancestors aren't asked for children
    assert rows[3] == ("profile-001.json", "profile", 0, 1, "N-1", True, '{"7": {"Id": 7}}')
    # the same as reading texts and unpacking
    raw = profiles.unpack(profiles.responses(spark, str(folder / "in/profile-00*.json")), "profile")
    assert sorted(json.loads(r.json)["Name"] for r in raw.collect()) == sorted(r[4] for r in rows if r[1] == "profile")
    assert len(spark.read.format("responses").load(str(folder / "in")).columns) == 3 + len(profiles.PROJECTIONS["profile"])
    assert spark.read.format("responses").load(str(folder / "none")).count() == 0


def test_a_projection_of_two_fields_decodes_two(folder):
    raw = (folder / "in/profile-001.json").read_bytes()
    decoder = Decoder(StructType.fromDDL("Id int, Name string"), None)
    assert list(decoder.rows("profile-001.json", raw)) == [(1, "N-1")] and decoder.decoded == 2
    whole = Decoder(StructType.fromDDL(", ".join(f"{f} string" for f in profiles.PROJECTIONS["profile"])), None)
    assert len(list(whole.rows("profile-001.json", raw))) == 1 and whole.decoded == 20
    # a field that the kind doesn't have, and one that isn't in the list
    assert list(Decoder(StructType.fromDDL("Suffix string, Secret string, Id long"), "ancestors").rows("x.json", json.dumps([{"ancestors": [{"Suffix": "Jr", "Secret": "x", "Id": "9"}]}]).encode())) == [(None, None, 9)]


def test_filters_skip_files(spark, folder, monkeypatch):
    df = spark.read.format("responses").option("filesPerPartition", "1").schema("file string, kind string, Name string").load(str(folder / "in"))
    assert [r.Name for r in df.where("kind = 'ancestors'").orderBy("Name").collect()] == ["N-1", "N-2"]
    assert df.where("kind = 'ancestors'").rdd.getNumPartitions() == 1
    late = df.where("file >= 'profile-004' and file < 'profile-900' and Name <> 'N-5'")
    assert sorted(r.Name for r in late.collect()) == ["N-4", "N-6"] and late.rdd.getNumPartitions() == 3
    reader = ResponseReader(StructType.fromDDL("file string"), {"path": str(folder / "in")})
    with pytest.raises(ValueError):
        ResponseReader(StructType.fromDDL("file string"), {"path": "x", "kind": "friends"})
    assert len(reader.partitions()) == 1


def test_a_stream_resumes(spark, folder):
    def run():
        df = spark.readStream.format("responses").schema("file string, kind string, Id int, Name string").option("kind", "profile").load(str(folder / "in"))
        q = df.writeStream.foreachBatch(lambda d, n: d.write.mode("overwrite").parquet(str(folder / f"out/n={n}"))).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return sorted(r.Name for r in spark.read.parquet(str(folder / "out")).collect())

    (folder / "in/ancestors-000.json").unlink()
    first = run()
    assert first == [f"N-{k}" for k in range(7)]
    assert run() == first
    for k in (910, 911):
        (folder / "in" / f"profile-{k}.json").write_text(json.dumps([{"profile": {"Id": k, "Name": f"N-{k}"}}]))
    assert run() == sorted([*first, "N-910", "N-911"])
    assert spark.read.parquet(str(folder / "out")).count() == 9

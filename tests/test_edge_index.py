"""The kept edge index: the walk's results by either way, what is read, and what is never written or shuffled."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heritree.operators import edge_index, graph

COLUMNS = "wiki_id string, father_wiki_id string, mother_wiki_id string"


def family(n, seed=1):
    """Persons with parents among earlier ones, some with one, some with the same twice, some with strangers; the first has very many children."""
    draw = random.Random(seed)
    rows = [("p0", None, None), (None, "p0", "p1")]
    for k in range(1, n):
        father, mother = (f"p{draw.randrange(max(0, k - 30), k)}" for _ in range(2))
        kind = k % 11
        rows.append((f"p{k}", "p0" if k % 3 == 0 else None if kind == 1 else father, father if kind == 2 else "stranger" if kind == 3 else "" if kind == 4 else mother))
    return rows


def bag(rows, seed, depth, up):
    """(id, depth) counts of the recursion, by its definition."""
    ids = {r[0] for r in rows if r[0] is not None}
    steps = {}
    for child, *parents in rows:
        for p in set(parents) & ids:
            if child is not None:
                a, b = (child, p) if up else (p, child)
                steps.setdefault(a, []).append(b)
    level, out = Counter({seed: 1} if seed in ids else {}), Counter()
    for d in range(depth + 1):
        out.update({(i, d): n for i, n in level.items()})
        new = Counter()
        for i, n in level.items():
            for j in steps.get(i, []):
                new[j] += n
        level = new
    return out


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = family(400)
    df = spark.createDataFrame(rows, COLUMNS)
    return rows, df, edge_index.build(df, f"file://{tmp_path_factory.mktemp('index')}/edges", buckets=8)


@pytest.mark.parametrize("up", [False, True])
@pytest.mark.parametrize("small", [0, 30, 20_000])
def test_walk_either_way(built, up, small):
    rows, df, index = built
    for seed, depth in (("p0", 1), ("p7", 6), ("p399", 10), ("nobody", 3), ("stranger", 2)):
        found = {(r["wiki_id"], r["tree_depth"]): r["paths"] for r in edge_index.walk(index, seed, depth, up, small).collect()}
        assert found == bag(rows, seed, depth, up)


def test_same_rows_as_without(built):
    rows, df, index = built
    df = df.where("wiki_id is not null").withColumns({c: F.lit(None).cast("string") for c in graph.ROW if c not in df.columns})
    key = lambda out: sorted((r["wiki_id"], r["tree_depth"]) for r in out.collect())
    for how in ({}, {"distinct": True}):
        assert key(graph.descendants(df, "p3", 4, index=index, **how)) == key(graph.descendants(df, "p3", 4, **how))
    assert graph.lineage_count(df, "p399", 8, up=True, index=index).first() == graph.lineage_count(df, "p399", 8, up=True).first()
    with pytest.raises(graph.BadRequest):
        graph.descendants(df, "p3", 11, index=index)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_lookup_reads_its_bucket_only(spark, built, tmp_path):
    """With the files of all other buckets spoiled, a lookup still answers."""
    rows, df, _ = built
    index = edge_index.build(df, f"file://{tmp_path}/spoiled", buckets=8)
    bucket = spark.range(1).select(F.pmod(F.hash(F.lit("p5")), F.lit(8))).first()[0]
    others = [f for f in (tmp_path / "spoiled/down").glob("part-*.parquet") if not re.search(rf"_{bucket:05d}\.c", f.name)]
    assert len(others) == 7
    for f in others:
        f.write_bytes(b"spoiled")
        (f.parent / f".{f.name}.crc").unlink()
    few = edge_index.steps(index, ["p5"])
    assert "Exchange" not in plan(few)
    assert {(r["to_id"], 1) for r in few.collect()} == {k for k in bag(rows, "p5", 1, False) if k[1]}


def test_edges_are_never_shuffled(spark, built):
    """A level's join shuffles the level to the edges' buckets and leaves the edges where they are."""
    _, _, index = built
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        level = spark.range(5000).select(F.concat(F.lit("p"), "id").alias("wiki_id"))
        joined = level.join(index.table().where("to_id is not null"), F.col("wiki_id") == F.col("from_id"))
        text = plan(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in text and len(re.findall(r"Exchange hashpartitioning", text)) == 1 and "Bucketed: true" in text


def test_traversals_write_no_edges(spark, built, monkeypatch):
    _, df, index = built
    written = []
    monkeypatch.setattr(edge_index, "stored_rows", lambda df, name: written.append(name) or (df, df.count()))
    edge_index.walk(index, "p0", 4).collect()
    assert written == []
    edge_index.walk(index, "p0", 4, small=0).collect()
    assert set(written) == {"walk-level"}


def test_opened_again(spark, built):
    rows, _, index = built
    again = edge_index.open_index(spark.newSession(), index.path)
    found = {(r["wiki_id"], r["tree_depth"]): r["paths"] for r in edge_index.walk(again, "p7", 5).collect()}
    assert found == bag(rows, "p7", 5, False) and again.buckets == 8
    with pytest.raises(FileNotFoundError):
        edge_index.open_index(spark, index.path + "-none")


def test_a_hot_parent_is_in_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(edge_index, "_ROWS", 100)
    df = spark.createDataFrame([("p0", None, None)] + [(f"p{k}", "p0", None) for k in range(1, 2000)], COLUMNS)
    index = edge_index.build(df, f"file://{tmp_path}/hot", buckets=4)
    files = index.table().where("from_id = 'p0' and to_id is not null").groupBy(F.input_file_name().alias("f")).count().collect()
    assert len(files) > 4 and max(r["count"] for r in files) < 1000
    assert edge_index.walk(index, "p0", 3, small=10).count() == 2000


def test_no_persons(spark, tmp_path):
    index = edge_index.build(spark.createDataFrame([], COLUMNS), f"file://{tmp_path}/none")
    assert not edge_index.walk(index, "p0", 3).count() and [r["edges"] for r in edge_index.summary(index).collect()] == [0, 0]

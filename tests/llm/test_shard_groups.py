"""Sharding where the matrix would be too large: partitions are drawn for by groups, and nothing else changes."""

import collections

import pytest

from heritree.llm import sharding


def table(spark, rows, parts):
    return spark.range(0, rows, 1, parts).selectExpr("id as doc_id", "concat('text ', id) as text", "'own' as piece", "spark_partition_id() as pid")


def test_many_shards_keep_all_tasks(spark, monkeypatch):
    seen = []
    inner = sharding.stored
    monkeypatch.setattr(sharding, "stored", lambda df, name: seen.append(df.rdd.getNumPartitions()) or inner(df, name))
    out = sharding.sharded_documents(table(spark, 3000, 64), 100_000).collect()
    assert seen == [64] and sorted(r.doc_id for r in out) == list(range(3000))
    assert max(collections.Counter(r.shard for r in out).values()) == 1 and {r.slot for r in out} == {0}


def test_groups_follow_the_law(spark, monkeypatch):
    """Row counts are exact; how partitions' rows spread over shards has the variance of a uniform shuffle."""
    monkeypatch.setattr(sharding, "MATRIX_CELLS", 15)  # 3 groups of 30 partitions
    docs = table(spark, 3000, 30)
    out = sharding.sharded_rows(docs, 5, seed=3).collect()
    assert sorted((r.shard, r.slot) for r in out) == [(s, k) for s in range(5) for k in range(600)] and {r.piece for r in out} == {"own"}
    cells = collections.Counter((r.doc_id * 30 // 3000, r.shard) for r in out)
    chi = sum((cells[p, s] - 20) ** 2 / 20 for p in range(30) for s in range(5))
    assert 70 < chi < 170  # 116 degrees of freedom
    order = [r.shard for r in sorted(out, key=lambda r: r.doc_id)]
    assert 450 < sum(a == b for a, b in zip(order, order[1:])) < 750
    # the same rows again
    assert sorted(map(tuple, sharding.sharded_rows(docs, 5, seed=3).collect())) == sorted(map(tuple, out))


@pytest.mark.parametrize("n", [1, 2, 3, 40, 41, 1000])
def test_shards_by_blocks(spark, n):
    line = [k % 3 for k in range(n)]
    ends = sharding._matrix_table(spark, [0], [line]).crossJoin(spark.range(sum(line)).withColumnRenamed("id", "local"))
    got = [r[0] for r in ends.orderBy("local").select(sharding._shard_of(ends["local"], n)).collect()]
    assert got == [s for s, k in enumerate(line) for _ in range(k)]

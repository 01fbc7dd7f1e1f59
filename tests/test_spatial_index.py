"""The packed index of boxes against brute force, and what a window reads."""

import random

import pytest
from pyspark.sql import functions as F

from heritree.operators import spatial_index as si

SCHEMA = "id long, min_x double, min_y double, max_x double, max_y double, row string"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    draw = random.Random(4)
    rows = []
    for k in range(6000):
        x, y = draw.gauss(0, 1000), draw.expovariate(1 / 500)
        rows.append((k, x, y, x + draw.choice([0.0, 5.0, 60.0]), y + 7.0, "own"))
    rows += [(6000 + k, 1.5, 2.5, 3.5, 4.5, None) for k in range(3000)]  # a third stands in one place
    rows += [(9000, None, 1.0, 2.0, 3.0, "x"), (9001, float("nan"), 1.0, 2.0, 3.0, "x")]
    index = si.build(spark.createDataFrame(rows, SCHEMA).repartition(5), f"file://{tmp_path_factory.mktemp('boxes')}/index", rows=300)
    return rows, index


def brute(rows, x1, y1, x2, y2):
    return sorted(r[0] for r in rows if r[1] is not None and r[1] == r[1] and r[1] <= x2 and r[3] >= x1 and r[2] <= y2 and r[4] >= y1)


def test_windows_by_brute_force(built):
    rows, index = built
    draw = random.Random(9)
    for _ in range(12):
        x, y, w, h = draw.gauss(0, 1500), draw.expovariate(1 / 500), draw.choice([0, 30, 800]), draw.choice([0, 30, 800])
        assert sorted(r["id"] for r in si.window(index, x, y, x + w, y + h).collect()) == brute(rows, x, y, x + w, y + h)
    r = rows[77]  # edges count
    assert 77 in [r["id"] for r in si.window(index, r[3], r[4], r[3] + 1, r[4] + 1).collect()]
    assert si.window(index, 1e9, 1e9, 2e9, 2e9).count() == 0


def test_points(built):
    rows, index = built
    assert si.at_point(index, 2.0, 3.0, "id").first()["id"] == brute(rows, 2, 3, 2, 3)[0]
    assert si.at_point(index, -1e9, 0, "id").count() == 0


def test_files_read_grow_with_the_window(built):
    rows, index = built
    files = index.tiles().count()
    assert files >= 25 and index.tiles().agg(F.max("n")).first()[0] < 900  # the crowded place is cut too
    read = lambda *w: len(si.window(index, *w).inputFiles())
    whole = (-4000.0, 0.0, 4000.0, 4000.0)
    small, wide, high = read(400.0, 400.0, 450.0, 450.0), read(-4000.0, 700.0, 4000.0, 720.0), read(600.0, 0.0, 620.0, 4000.0)
    assert small <= 4 and wide <= files / 2 and high <= files / 2 and read(*whole) >= files - 2  # both directions prune
    areas = [read(200.0, 200.0, 200.0 + s, 200.0 + s) for s in (20, 400, 1500)]
    assert areas == sorted(areas) and areas[0] < areas[2]


def test_many_windows(spark, built):
    rows, index = built
    asked = [(k, float(k * 50 - 400), 100.0, float(k * 50 - 300), 300.0) for k in range(15)]
    found = si.windows(index, spark.createDataFrame(asked, "w long, x1 double, y1 double, x2 double, y2 double")).collect()
    assert sorted((r["w"], r["id"]) for r in found) == sorted((w, i) for w, *box in asked for i in brute(rows, *box))


@pytest.mark.parametrize("listed", [0, 10_000])
def test_many_windows_move_no_box_while_their_files_are_few(spark, built, monkeypatch, listed):
    rows, index = built
    monkeypatch.setattr(si, "_LISTED", listed)
    asked = [(k, float(k * 50 - 400), 100.0, float(k * 50 - 300), 300.0) for k in range(15)]
    found = si.windows(index, spark.createDataFrame(asked, "w long, x1 double, y1 double, x2 double, y2 double"))
    assert sorted((r["w"], r["id"]) for r in found.collect()) == sorted((w, i) for w, *box in asked for i in brute(rows, *box))
    if listed:
        assert "BroadcastHashJoin" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "Exchange hashpartitioning" not in plan
        assert len(found.inputFiles()) < index.tiles().count()
    far = spark.createDataFrame([(1, 1e9, 1e9, 2e9, 2e9)], "w long, x1 double, y1 double, x2 double, y2 double")
    assert si.windows(index, far).count() == 0


def test_boxes_are_not_stored_twice_for_their_order(spark, tmp_path, monkeypatch):
    folder = tmp_path / "shared"
    monkeypatch.setattr("heritree.storage.shared_dir", lambda spark: f"file://{folder}")
    df = spark.range(5000).select("id", *[(F.col("id") % m).cast("double").alias(c) for c, m in zip(si.BOX, (70, 90, 70, 90))], F.lit("x").alias("__place0"))
    index = si.build(df, f"file://{tmp_path}/index", rows=500)
    assert not folder.exists()
    assert index.boxes().columns == df.columns and sorted(index.boxes().collect()) == sorted(df.collect()) and index.tiles().count() > 5


def test_hilbert_visits_every_cell_once_and_steps_by_one(spark):
    cells = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    order = [(r["x"], r["y"]) for r in cells.withColumn("d", si.hilbert(F.col("x"), F.col("y"), 3)).orderBy("d").collect()]
    assert len(set(order)) == 64 and all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(order, order[1:]))


def test_opened_again_and_empty(spark, built, tmp_path):
    rows, index = built
    again = si.open_index(spark, index.path)
    assert sorted(r["id"] for r in si.window(again, 0, 0, 50, 50).collect()) == brute(rows, 0, 0, 50, 50)
    with pytest.raises(FileNotFoundError):
        si.open_index(spark, f"file://{tmp_path}/none")
    none = si.build(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/empty")
    assert si.window(none, 0, 0, 1, 1).count() == 0
    one = si.build(spark.createDataFrame([(1, 1.0, 1.0, 2.0, 2.0, "r")], SCHEMA), f"file://{tmp_path}/one")
    assert si.window(one, 0, 0, 1, 1).first()["row"] == "r"

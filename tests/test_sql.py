"""SQL functions of a session against the Column functions and traversals that they stand for."""

import pytest
from pyspark.sql import functions as F

from heritree import sql
from heritree.operators import graph
from heritree.sources import fixtures as fx

ODD = ["", " ", None, "0000-01-01", "about 1850-05", "12", "Berks ,PA.", " a , b ;", "Müller", "'quoted' \\ text", "0", "Male", "Female", "P-1", "日本 , x"]


def test_scalars_equal_their_column_functions(spark):
    sql.register_scalars(spark, "t_")
    for name, (function, parameters) in sql.SCALARS.items():
        if set(parameters.values()) == {"DOUBLE"}:
            rows = [tuple(float(v) + k for k in range(len(parameters))) for v in (-3, 0, 0.3, 0.7, 2, 100)] + [(None,) * len(parameters)]
        else:
            rows = [tuple(ODD[(i + 4 * k) % len(ODD)] for k in range(len(parameters))) for i in range(len(ODD))]
        df = spark.createDataFrame(rows, ", ".join(f"`{p}` {t}" for p, t in parameters.items()))
        both = df.select(function(*[F.col(p) for p in parameters]).alias("a"), F.expr(f"t_{name}({', '.join(f'`{p}`' for p in parameters)})").alias("b"))
        for r in both.collect():
            assert r["a"] == r["b"], (name, r)


@pytest.mark.parametrize("indexed", [False, True])
def test_traversals(spark, sf_dir, tmp_path, indexed):
    from heritree.operators import edge_index

    persons = fx.persons(spark, sf_dir).cache()
    index = edge_index.build(persons, f"file://{tmp_path}/index") if indexed else None
    made = sql.register(spark, persons, fx.relationships(spark, sf_dir), index)
    assert made == ["descendants", "ancestors", "children_of", "parents_of", "search_persons", "spouses_of"]
    key = lambda df: sorted((r["wiki_id"], r["tree_depth"]) for r in df.collect())
    assert key(spark.sql("SELECT * FROM descendants('P-0', 5)")) == key(graph.descendants(persons, "P-0", 5))
    assert key(spark.sql("SELECT * FROM ancestors('P-96', 3)")) == key(graph.ancestors(persons, "P-96", 3))
    assert spark.sql("SELECT * FROM descendants('nobody', 5)").count() == 0
    # in a larger statement
    top = spark.sql("SELECT tree_depth, count(*) AS n FROM descendants('P-0', 3) d JOIN persons p USING (wiki_id) GROUP BY 1 ORDER BY 1").collect()
    assert [r["tree_depth"] for r in top] == [0, 1, 2, 3]
    with pytest.raises(Exception, match="depth must be 1 to 10"):
        spark.sql("SELECT * FROM descendants('P-0', 11)").collect()
    assert spark.sql("SELECT * FROM search_persons(NULL, NULL)").count() == persons.count()

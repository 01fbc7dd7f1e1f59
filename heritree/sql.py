"""SQL access: the scalar functions and the traversals as functions of a session.

A scalar function's SQL is the text of the Column function's own expression, so both say the same. The traversals are SQL
table functions over the session's views; their recursion is Spark's own, which lists paths and so stops at its row limit
(`spark.sql.cteRecursionRowLimit`), where `graph.lineage` counts them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import graph
from .operators.edge_index import EdgeIndex
from .operators.search import LOCATION_COLUMNS, NAME_COLUMNS

_T, _D = "STRING", "DOUBLE"
#: name: function, parameters (name to type).
SCALARS: dict[str, tuple[Callable[..., Column], dict[str, str]]] = {
    "parse_year": (text.parse_year, {"date": _T}),
    "year_start": (text.year_start, {"date": _T}),
    "location_key": (text.location_key, {"raw": _T}),
    "full_name": (text.full_name, {"first": _T, "middle": _T, "birth_last": _T, "current_last": _T, "suffix": _T, "name": _T}),
    "profile_date": (text.profile_date, {"date": _T}),
    "display_name": (text.display_name, {"name": _T, "first": _T, "middle": _T, "last": _T, "wiki_id": _T}),
    "map_name": (text.map_name, {"name": _T, "first": _T, "last": _T}),
    "gender_code": (text.gender_code, {"gender": _T}),
    "lifespan": (text.lifespan, {"birth": _T, "death": _T}),
    "detail_level": (text.detail_level, {"zoom": _D}),
    "marker_radius": (text.marker_radius, {"n": _D}),
    "cluster_label": (text.cluster_label, {"normalized": _T, "city": _T, "state": _T}),
    "cluster_id": (text.cluster_id, {"lat": _D, "lon": _D}),
    "valid_id": (text.valid_id, {"id": _T}),
    "start_id_format": (text.start_id_format, {"id": _T}),
    "pair_key": (text.pair_key, {"a": _T, "b": _T}),
    "edge_key": (text.edge_key, {"parent": _T, "child": _T}),
}


def expression_sql(spark: SparkSession, function: Callable[..., Column], parameters: dict[str, str]) -> tuple[str, str]:
    """The SQL of function(parameters), and its type."""
    none = spark.range(0).select(*[F.lit(None).cast(t).alias(p) for p, t in parameters.items()])
    out = none.select(function(*[F.col(p) for p in parameters]).alias("value"))
    expression = out._jdf.queryExecution().analyzed().expressions().head().child()
    return expression.sql(), out.schema["value"].dataType.simpleString()


def register_scalars(spark: SparkSession, prefix: str = "") -> list[str]:
    """Registers the scalar functions, named with the prefix, and returns their names."""
    for name, (function, parameters) in SCALARS.items():
        body, kind = expression_sql(spark, function, parameters)
        given = ", ".join(f"`{p}` {t}" for p, t in parameters.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({given}) RETURNS {kind} RETURN {body}")
    return [prefix + n for n in SCALARS]


def register(spark: SparkSession, persons: DataFrame, relationships: DataFrame | None = None, index: EdgeIndex | None = None) -> list[str]:
    """Registers the views persons, parent_edges and relationships, and the table functions over them; returns the functions' names.

    descendants(seed, depth), ancestors(seed, depth): person columns and tree_depth, a row for each path, depth 1 to 10.
    children_of(id), parents_of(id), spouses_of(id): person columns. search_persons(term, place): those whose names and
    places hold the texts, in which % and _ are wildcards; a null text asks for nothing. With an index of the persons' edges
    steps read that.
    """
    persons.createOrReplaceTempView("persons")
    if index:
        edges = index.table().where("to_id is not null").select(F.col("from_id").alias("parent"), F.col("to_id").alias("child"))
        up = index.table(up=True).where("to_id is not null").select(F.col("from_id").alias("child"), F.col("to_id").alias("parent"))
    else:
        edges = up = graph.present_edges(persons).select("child", "parent").distinct()
    edges.createOrReplaceTempView("parent_edges")
    up.createOrReplaceTempView("child_edges")
    kinds = {f.name: f.dataType.simpleString() for f in persons.schema.fields}
    columns = [c for c in graph.ROW if c in kinds]
    rows, listed = ", ".join(f"{c} {kinds[c]}" for c in columns), ", ".join(f"p.{c}" for c in columns)
    made = []

    def add(name: str, parameters: str, returns: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({returns}) RETURN {body}")
        made.append(name)

    for name, view, start, end in (("descendants", "parent_edges", "parent", "child"), ("ancestors", "child_edges", "child", "parent")):
        checked = f"CASE WHEN depth BETWEEN 1 AND {graph.MAX_DEPTH} THEN depth ELSE raise_error('depth must be 1 to {graph.MAX_DEPTH}') END"
        add(name, "seed STRING, depth INT", f"{rows}, tree_depth int", f"""WITH RECURSIVE walk(wiki_id, tree_depth) AS (
                SELECT wiki_id, 0 FROM persons WHERE wiki_id = seed
                UNION ALL SELECT e.{end}, w.tree_depth + 1 FROM walk w JOIN {view} e ON e.{start} = w.wiki_id WHERE w.tree_depth < {checked})
            SELECT {listed}, w.tree_depth FROM walk w JOIN persons p ON p.wiki_id = w.wiki_id""")  # fmt: skip
    add("children_of", "id STRING", rows, f"SELECT {listed} FROM persons p WHERE p.father_wiki_id = children_of.id OR p.mother_wiki_id = children_of.id")
    add("parents_of", "id STRING", rows, f"SELECT {listed} FROM persons p LEFT SEMI JOIN (SELECT explode(array(father_wiki_id, mother_wiki_id)) AS parent FROM persons WHERE wiki_id = parents_of.id) e ON p.wiki_id = e.parent")
    likes = lambda term, names: f"({term} IS NULL OR " + " OR ".join(f"p.{c} ILIKE concat('%', {term}, '%')" for c in names) + ")"
    add("search_persons", "term STRING, place STRING", rows, f"SELECT {listed} FROM persons p WHERE {likes('term', [c for c in NAME_COLUMNS if c in kinds])} AND {likes('place', [c for c in LOCATION_COLUMNS if c in kinds])}")
    if relationships is not None:
        relationships.createOrReplaceTempView("relationships")
        mates = "SELECT r.related_person_id FROM relationships r JOIN persons me ON me.id = r.person_id WHERE r.relationship_type = 'spouse' AND me.wiki_id = spouses_of.wiki"
        add("spouses_of", "wiki STRING", rows, f"SELECT {listed} FROM persons p LEFT SEMI JOIN ({mates}) m ON p.id = m.related_person_id")
    return made

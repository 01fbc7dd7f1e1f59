"""The published queries: one for each operator, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import edge_index, geo, graph, ingest, layout, ordered_table, queue, search, spatial, spatial_index, substring_index, versioned_table
from ..sources import fixtures as fx
from ..sources import profiles
from ..storage import kept
from ..sources.fixtures import ROOT, key_sql, table, with_fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def published(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_NAMES = " OR ".join(f"{c} ILIKE '%{{0}}%' ESCAPE '\\'" for c in search.NAME_COLUMNS)
_PLACES = " OR ".join(f"{c} ILIKE '%{{0}}%' ESCAPE '\\'" for c in search.LOCATION_COLUMNS)

# --- traversals ------------------------------------------------------------------------------------------------------

_PERSON = "p.id, p.wiki_id, p.name, p.gender, p.birth_date, p.father_wiki_id, p.mother_wiki_id"


def _walk_sql(depth: int, up: bool = False) -> str:
    """The recursion as it is asked for, with the disjunctive join."""
    join = "p.wiki_id = w.father_wiki_id OR p.wiki_id = w.mother_wiki_id" if up else "p.father_wiki_id = w.wiki_id OR p.mother_wiki_id = w.wiki_id"
    seed = "(SELECT max(wiki_id) FROM persons WHERE id % 2 = 1)" if up else f"'{ROOT}'"
    return f"""walk AS (SELECT {_PERSON}, 0 AS tree_depth FROM persons p WHERE p.wiki_id = {seed}
        UNION ALL SELECT {_PERSON}, w.tree_depth + 1 FROM persons p JOIN walk w ON {join} WHERE w.tree_depth < {depth})"""


_COLUMNS = ["id", "wiki_id", "name", "gender", "birth_date", "father_wiki_id", "mother_wiki_id", "tree_depth"]
_ALL = "SELECT id, wiki_id, name, gender, birth_date, father_wiki_id, mother_wiki_id, CAST(tree_depth AS INTEGER) AS tree_depth FROM walk"
_PAGE = "SELECT id, wiki_id, name, tree_depth, count(*) OVER () AS total FROM walk ORDER BY tree_depth, name NULLS LAST, wiki_id LIMIT 100"


def _index(spark: SparkSession, d: str) -> edge_index.EdgeIndex:
    """The persons' edges, indexed once for all traversals of an application."""
    return edge_index.kept(spark, d, lambda: fx.persons(spark, d))


@published(with_fixtures("edges", """SELECT direction, (SELECT count(*) FROM persons) AS persons, count(*) AS edges, max(n) AS most FROM (SELECT 'down' AS direction, count(*) OVER (PARTITION BY parent) AS n FROM e UNION ALL SELECT 'up', count(*) OVER (PARTITION BY child) FROM e) GROUP BY direction""", more="e AS (SELECT DISTINCT child, parent FROM edges WHERE parent IN (SELECT wiki_id FROM persons))"))
def edge_index_summary(spark: SparkSession, d: str) -> DataFrame:
    return edge_index.summary(_index(spark, d))


@published(with_fixtures("persons", _ALL, True, _walk_sql(4)))
def descendants_d4(spark: SparkSession, d: str) -> DataFrame:
    return graph.descendants(fx.persons(spark, d), ROOT, 4, index=_index(spark, d)).select(*_COLUMNS)


@published(with_fixtures("persons", _ALL, True, _walk_sql(10)))
def descendants_d10(spark: SparkSession, d: str) -> DataFrame:
    return graph.descendants(fx.persons(spark, d), ROOT, 10, index=_index(spark, d)).select(*_COLUMNS)


@published(with_fixtures("persons", "SELECT id, wiki_id, name, CAST(tree_depth AS INTEGER) AS tree_depth, total FROM (" + _PAGE + ")", True, _walk_sql(4)))
def descendants_page(spark: SparkSession, d: str) -> DataFrame:
    return graph.page(graph.descendants(fx.persons(spark, d), ROOT, 4, index=_index(spark, d)), 100).select("id", "wiki_id", "name", "tree_depth", "total")


@published(with_fixtures("persons", "SELECT count(*) AS total FROM walk", True, _walk_sql(10)))
def descendants_count(spark: SparkSession, d: str) -> DataFrame:
    return graph.lineage_count(fx.persons(spark, d), ROOT, 10, index=_index(spark, d))


@published(with_fixtures("persons", "SELECT wiki_id, CAST(min(tree_depth) AS INTEGER) AS tree_depth FROM walk GROUP BY wiki_id", True, _walk_sql(4)))
def descendants_distinct(spark: SparkSession, d: str) -> DataFrame:
    return graph.descendants(fx.persons(spark, d), ROOT, 4, distinct=True, index=_index(spark, d)).select("wiki_id", "tree_depth")


@published(with_fixtures("persons", _ALL, True, _walk_sql(4, up=True)))
def ancestors_d4(spark: SparkSession, d: str) -> DataFrame:
    p = fx.persons(spark, d)
    youngest = p.where("id % 2 = 1").agg(F.max("wiki_id")).first()[0]  # one value, the query's seed
    return graph.ancestors(p, youngest, 4, index=_index(spark, d)).select(*_COLUMNS)


@published(with_fixtures("persons", "SELECT count(*) AS n FROM persons WHERE wiki_id = 'nobody'"))
def unknown_seed(spark: SparkSession, d: str) -> DataFrame:
    return graph.descendants(fx.persons(spark, d), "nobody", 4, index=_index(spark, d)).agg(F.count("*").alias("n"))


def _session(spark: SparkSession, d: str) -> None:
    """The session's SQL functions over these tables."""
    from .. import sql

    sql.register(spark, fx.persons(spark, d), fx.relationships(spark, d), _index(spark, d))
    sql.register_scalars(spark, "h_")


@published(with_fixtures("persons", _ALL, True, _walk_sql(4)))
def sql_descendants(spark: SparkSession, d: str) -> DataFrame:
    _session(spark, d)
    return spark.sql(f"SELECT {', '.join(_COLUMNS)} FROM descendants('{ROOT}', 4)")


@published(with_fixtures("persons", _ALL, True, _walk_sql(4, up=True)))
def sql_ancestors(spark: SparkSession, d: str) -> DataFrame:
    _session(spark, d)
    youngest = spark.sql("SELECT max(wiki_id) FROM persons WHERE id % 2 = 1").first()[0]
    return spark.sql(f"SELECT {', '.join(_COLUMNS)} FROM ancestors(:seed, 4)", args={"seed": youngest})


@published(with_fixtures("persons relationships", "SELECT 'child' AS kind, id, wiki_id, name FROM persons WHERE father_wiki_id = 'P-2' OR mother_wiki_id = 'P-2' UNION ALL SELECT 'spouse', id, wiki_id, name FROM persons WHERE id IN (SELECT related_person_id FROM relationships WHERE relationship_type = 'spouse' AND person_id = 1) UNION ALL SELECT 'parent', p.id, p.wiki_id, p.name FROM persons p JOIN persons c ON p.wiki_id IN (c.father_wiki_id, c.mother_wiki_id) WHERE c.wiki_id = 'P-40'"))
def sql_relatives(spark: SparkSession, d: str) -> DataFrame:
    _session(spark, d)
    return spark.sql("SELECT 'child' AS kind, id, wiki_id, name FROM children_of('P-2') UNION ALL SELECT 'spouse', id, wiki_id, name FROM spouses_of('P-0') UNION ALL SELECT 'parent', id, wiki_id, name FROM parents_of('P-40')")


@published(with_fixtures("persons", f"SELECT id, wiki_id, name FROM persons WHERE ({_NAMES.format('line1')}) AND ({_PLACES.format('nation')})"))
def sql_search(spark: SparkSession, d: str) -> DataFrame:
    _session(spark, d)
    return spark.sql("SELECT id, wiki_id, name FROM search_persons('line1', 'nation')")


@published(with_fixtures("persons", f"SELECT wiki_id, CAST(nullif(regexp_extract(birth_date, '([0-9]{{4}})', 1), '') AS INTEGER) AS birth_year, {key_sql('birth_location')} AS location_key, CASE gender WHEN 'Male' THEN 'M' WHEN 'Female' THEN 'F' ELSE 'U' END AS gender, coalesce(nullif(name, ''), wiki_id) AS shown FROM persons"))
def sql_scalars(spark: SparkSession, d: str) -> DataFrame:
    _session(spark, d)
    return spark.sql("SELECT wiki_id, h_parse_year(birth_date) AS birth_year, h_location_key(birth_location) AS location_key, h_gender_code(gender) AS gender, h_display_name(name, NULL, NULL, NULL, wiki_id) AS shown FROM persons")


@published(with_fixtures("persons", "SELECT p.wiki_id, p.name, f.wiki_id AS father, f.name AS father_name, m.wiki_id AS mother, m.name AS mother_name FROM persons p LEFT JOIN persons f ON p.father_wiki_id = f.wiki_id LEFT JOIN persons m ON p.mother_wiki_id = m.wiki_id WHERE p.wiki_id = 'P-40'"))
def person_parents(spark: SparkSession, d: str) -> DataFrame:
    return graph.parents_of(fx.persons(spark, d), "P-40").select("wiki_id", "name", F.col("father.wiki_id").alias("father"), F.col("father.name").alias("father_name"), F.col("mother.wiki_id").alias("mother"), F.col("mother.name").alias("mother_name"))


@published(with_fixtures("persons", "SELECT id, wiki_id, name FROM persons WHERE father_wiki_id = 'P-2' OR mother_wiki_id = 'P-2'"))
def person_children(spark: SparkSession, d: str) -> DataFrame:
    return graph.children_of(fx.persons(spark, d), "P-2").select("id", "wiki_id", "name")


@published(with_fixtures("persons relationships", "SELECT id, wiki_id, name FROM persons WHERE id IN (SELECT related_person_id FROM relationships WHERE relationship_type = 'spouse' AND person_id = (SELECT id FROM persons WHERE wiki_id = 'P-0'))"))
def person_spouses(spark: SparkSession, d: str) -> DataFrame:
    return graph.spouses_of(fx.persons(spark, d), fx.relationships(spark, d), "P-0").select("id", "wiki_id", "name")


@published(with_fixtures("persons", "SELECT id, wiki_id, name, CAST(tree_depth AS INTEGER) AS tree_depth, total FROM (" + _PAGE.replace("LIMIT 100", "LIMIT 10 OFFSET 2") + ")", True, _walk_sql(6, up=True)))
def ancestors_page(spark: SparkSession, d: str) -> DataFrame:
    p = fx.persons(spark, d)
    youngest = p.where("id % 2 = 1").agg(F.max("wiki_id")).first()[0]
    return graph.page(graph.ancestors(p, youngest, 6, index=_index(spark, d)), 10, 2).select("id", "wiki_id", "name", "tree_depth", "total")


@published(with_fixtures("persons", "SELECT count(*) AS total FROM walk", True, _walk_sql(10, up=True)))
def ancestors_count(spark: SparkSession, d: str) -> DataFrame:
    p = fx.persons(spark, d)
    return graph.lineage_count(p, p.where("id % 2 = 1").agg(F.max("wiki_id")).first()[0], 10, up=True, index=_index(spark, d))


@published(with_fixtures("persons", "SELECT p.* EXCLUDE (birth_location_key, generation), 0 AS tree_depth FROM persons p WHERE wiki_id = 'P-0' UNION ALL SELECT p.* EXCLUDE (birth_location_key, generation), 1 FROM persons p WHERE father_wiki_id = 'P-0' OR mother_wiki_id = 'P-0'"))
def descendants_columns(spark: SparkSession, d: str) -> DataFrame:
    return graph.descendants(fx.persons(spark, d), ROOT, 1)


@published(with_fixtures("persons relationships", """SELECT p.wiki_id, p.name, f.wiki_id AS father, m.wiki_id AS mother, (SELECT string_agg(c.wiki_id, ',' ORDER BY c.wiki_id) FROM persons c WHERE c.father_wiki_id = 'P-40' OR c.mother_wiki_id = 'P-40') AS children,
    (SELECT string_agg(s.wiki_id, ',' ORDER BY s.wiki_id) FROM persons s WHERE s.id IN (SELECT related_person_id FROM relationships WHERE relationship_type = 'spouse' AND person_id = 41)) AS spouses
    FROM persons p LEFT JOIN persons f ON p.father_wiki_id = f.wiki_id LEFT JOIN persons m ON p.mother_wiki_id = m.wiki_id WHERE p.wiki_id = 'P-40'"""))  # fmt: skip
def get_person(spark: SparkSession, d: str) -> DataFrame:
    listed = lambda c: F.array_join(F.transform(c, lambda x: x["wiki_id"]), ",").alias(c)
    return graph.get_person(fx.persons(spark, d), fx.relationships(spark, d), "P-40").select("person.wiki_id", "person.name", F.col("father.wiki_id").alias("father"), F.col("mother.wiki_id").alias("mother"), listed("children"), listed("spouses"))


# --- search, counts --------------------------------------------------------------------------------------------------


def _search_sql(where: str, limit: int = 50, offset: int = 0) -> str:
    return with_fixtures("persons", f"SELECT id, wiki_id, name, birth_location, count(*) OVER () AS total FROM persons {where} ORDER BY name NULLS LAST, wiki_id LIMIT {limit} OFFSET {offset}")


def _found(df: DataFrame) -> DataFrame:
    return df.select("id", "wiki_id", "name", "birth_location", "total")


@published(_search_sql("WHERE " + _NAMES.format("line1")))
def search_name(spark: SparkSession, d: str) -> DataFrame:
    return _found(search.search_persons(fx.persons(spark, d), query="line1"))


@published(_search_sql("WHERE " + _PLACES.format("nation_1")))
def search_location(spark: SparkSession, d: str) -> DataFrame:
    return _found(search.search_persons(fx.persons(spark, d), location="nation_1"))


@published(_search_sql(f"WHERE ({_NAMES.format('customer')}) AND ({_PLACES.format('a')})", 20, 20))
def search_both_page2(spark: SparkSession, d: str) -> DataFrame:
    return _found(search.search_persons(fx.persons(spark, d), query="customer", location="a", limit=20, offset=20))


@published(_search_sql(""))
def search_no_filter(spark: SparkSession, d: str) -> DataFrame:
    return _found(search.search_persons(fx.persons(spark, d), year_from=1700, year_to=1701))


@published(_search_sql("WHERE " + _NAMES.format("l_ne%1")))
def search_wildcards(spark: SparkSession, d: str) -> DataFrame:
    return _found(search.search_persons(fx.persons(spark, d), query="l_ne%1"))


def _trigrams(spark: SparkSession, d: str) -> substring_index.SubstringIndex:
    """The persons in order of their names with trigrams, built once for all searches of an application."""
    return substring_index.kept(spark, d, lambda: fx.persons(spark, d))


@published(_search_sql("WHERE " + _NAMES.format("line1")))
def indexed_search_name(spark: SparkSession, d: str) -> DataFrame:
    return _found(substring_index.search_persons(_trigrams(spark, d), query="line1"))


@published(_search_sql("WHERE " + _PLACES.format("nation_1")))
def indexed_search_location(spark: SparkSession, d: str) -> DataFrame:
    return _found(substring_index.search_persons(_trigrams(spark, d), location="nation_1"))


@published(_search_sql(f"WHERE ({_NAMES.format('customer')}) AND ({_PLACES.format('region_2')})", 20, 20))
def indexed_search_both_page2(spark: SparkSession, d: str) -> DataFrame:
    return _found(substring_index.search_persons(_trigrams(spark, d), query="customer", location="region_2", limit=20, offset=20))


@published(_search_sql("WHERE " + _NAMES.format("l_ne%1")))
def indexed_search_wildcards(spark: SparkSession, d: str) -> DataFrame:
    return _found(substring_index.search_persons(_trigrams(spark, d), query="l_ne%1"))


@published(_search_sql("", 50, 100))
def indexed_page(spark: SparkSession, d: str) -> DataFrame:
    return _found(substring_index.search_persons(_trigrams(spark, d), offset=100))


def _ordered(spark: SparkSession, d: str) -> ordered_table.OrderedTable:
    """All orders by customer, kept in that order."""
    built = kept(spark, "ordered-orders", d, lambda path: ordered_table.build(table(spark, d, "orders").select("o_orderkey", "o_custkey"), path, ("o_custkey", "o_orderkey"), rows=20_000))
    return ordered_table.open_table(spark, built.path)


@published("SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_custkey NULLS LAST, o_orderkey LIMIT 100 OFFSET 1300")
def deep_page(spark: SparkSession, d: str) -> DataFrame:
    return ordered_table.page(_ordered(spark, d), 100, 1300)


@published("SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders) AS total FROM orders WHERE o_custkey > 77 OR o_custkey = 77 AND o_orderkey > 500 ORDER BY o_custkey NULLS LAST, o_orderkey LIMIT 100")
def page_after_token(spark: SparkSession, d: str) -> DataFrame:
    t = _ordered(spark, d)
    return ordered_table.page_after(t, 100, ordered_table.token({"o_custkey": 77, "o_orderkey": 500}, t.keys))


@published(with_fixtures("persons relationships", "SELECT (SELECT count(*) FROM persons) AS persons, (SELECT count(*) FROM relationships) AS relationships"))
def stats(spark: SparkSession, d: str) -> DataFrame:
    return search.stats(fx.persons(spark, d), fx.relationships(spark, d))


@published(with_fixtures("persons locations", """SELECT total_locations, geocoded_locations, persons_with_coordinates, CASE WHEN total_locations > 0 THEN geocoded_locations / total_locations * 100 ELSE 0.0 END AS percent_complete FROM
    (SELECT count(DISTINCT birth_location_key) AS total_locations FROM persons), (SELECT count(*) AS geocoded_locations FROM locations),
    (SELECT count(*) AS persons_with_coordinates FROM persons JOIN locations ON birth_location_key = location_key WHERE latitude IS NOT NULL)"""))  # fmt: skip
def geocoding_status(spark: SparkSession, d: str) -> DataFrame:
    return geo.geocoding_status(fx.persons(spark, d), fx.locations(spark, d))


@published("SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def top_names(spark: SparkSession, d: str) -> DataFrame:
    return search.top(table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment")), "segment")


@published(with_fixtures("persons", "SELECT generation, count(*) AS n FROM persons GROUP BY 1"))
def persons_per_generation(spark: SparkSession, d: str) -> DataFrame:
    return fx.persons(spark, d).groupBy("generation").agg(F.count("*").alias("n"))


@published("SELECT c_custkey AS total, (c_custkey % 5) * 20 AS offset_rows, CAST(ceil(c_custkey / 20) AS BIGINT) AS pages, CASE WHEN c_custkey > 0 THEN (c_custkey % 5) * 20 + 1 ELSE 0 END AS shown_from, least((c_custkey % 5) * 20 + 20, c_custkey) AS shown_to FROM customer")
def page_math(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    m = search.page_math(k, k % 5 + 1)
    return table(spark, d, "customer").select(k.alias("total"), m["offset"].alias("offset_rows"), m["pages"].cast("long").alias("pages"), m["shown_from"].cast("long").alias("shown_from"), m["shown_to"].alias("shown_to"))


# --- map -------------------------------------------------------------------------------------------------------------

_LOCATED = """located AS (SELECT p.id AS person_id, p.wiki_id, p.name, p.first_name, p.last_name_current AS last_name, TRY_CAST(nullif(regexp_extract(p.birth_date, '([0-9]{{4}})', 1), '') AS INTEGER) AS birth_year, p.gender,
    latitude, longitude, normalized_name AS location_name, state, city FROM persons p JOIN locations ON {0} WHERE latitude IS NOT NULL AND longitude IS NOT NULL)"""
_BY_KEY, _BY_RAW = _LOCATED.format("p.birth_location_key = location_key"), _LOCATED.format("p.birth_location = raw_location")
_NUMBER = "regexp_replace(CAST({0} AS VARCHAR), '\\.0$', '')"
_POINTS = f""", points AS (SELECT {_NUMBER.format("latitude")} || ',' || {_NUMBER.format("longitude")} AS id, latitude, longitude, count(*) AS person_count,
    arg_min(coalesce(nullif(location_name, ''), nullif(city, ''), nullif(state, ''), 'Unknown'), person_id) AS location_name, arg_min(state, person_id) AS state,
    coalesce(min(birth_year), 9999) AS min_year, coalesce(max(birth_year), 0) AS max_year FROM located {{0}} GROUP BY latitude, longitude)"""
_POINT_COLUMNS = ["id", "latitude", "longitude", "person_count", "location_name", "state", "min_year", "max_year"]


def _points_sql(where: str = "", select: str = "SELECT * FROM points", by: str = _BY_KEY) -> str:
    return with_fixtures("persons locations", select, more=by + _POINTS.format(where))


def _points(spark: SparkSession, d: str, low: int | None = None, high: int | None = None) -> DataFrame:
    rows = geo.in_years(geo.located(fx.persons(spark, d), fx.locations(spark, d)), low, high)
    return geo.clusters(rows, with_persons=False).select(*_POINT_COLUMNS)


@published(with_fixtures("persons locations", "SELECT person_id, wiki_id, birth_year, latitude, longitude FROM located", more=_BY_KEY))
def map_join_key(spark: SparkSession, d: str) -> DataFrame:
    return geo.located(fx.persons(spark, d), fx.locations(spark, d)).select("person_id", "wiki_id", "birth_year", "latitude", "longitude")


@published(with_fixtures("persons locations", "SELECT person_id, wiki_id, birth_year, latitude, longitude FROM located", more=_BY_RAW))
def map_join_raw(spark: SparkSession, d: str) -> DataFrame:
    return geo.located(fx.persons(spark, d), fx.locations(spark, d), raw=True).select("person_id", "wiki_id", "birth_year", "latitude", "longitude")


@published(_points_sql())
def map_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d)


_PERSON_NAME = "coalesce(nullif(name, ''), nullif(trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '')), ''))"


@published(with_fixtures("persons locations", f"SELECT {_NUMBER.format('latitude')} || ',' || {_NUMBER.format('longitude')} AS id, person_id, wiki_id, {_PERSON_NAME} AS name, birth_year, gender FROM located", more=_BY_KEY))
def map_persons(spark: SparkSession, d: str) -> DataFrame:
    return geo.cluster_persons(geo.located(fx.persons(spark, d), fx.locations(spark, d)))


@published(with_fixtures("persons locations", f"SELECT {_NUMBER.format('latitude')} || ',' || {_NUMBER.format('longitude')} AS id, string_agg(person_id || ':' || wiki_id || ':' || {_PERSON_NAME} || ':' || coalesce(CAST(birth_year AS VARCHAR), '') || ':' || CASE gender WHEN 'Male' THEN 'M' WHEN 'Female' THEN 'F' ELSE 'U' END, ',' ORDER BY person_id) AS persons FROM located GROUP BY latitude, longitude", more=_BY_KEY))
def map_nested_coded(spark: SparkSession, d: str) -> DataFrame:
    c = geo.clusters(geo.located(fx.persons(spark, d), fx.locations(spark, d)), coded=True)
    line = lambda p: F.concat(p["person_id"], F.lit(":"), p["wiki_id"], F.lit(":"), p["name"], F.lit(":"), F.coalesce(p["birth_year"].cast("string"), F.lit("")), F.lit(":"), p["gender"])
    return c.select("id", F.array_join(F.transform("persons", line), ",").alias("persons"))


@published(with_fixtures("persons locations", f"""SELECT latitude, label || chr(10) || n || CASE n WHEN 1 THEN ' person' ELSE ' people' END || CASE WHEN low IS NULL THEN '' WHEN low = high THEN chr(10) || 'Born ' || low ELSE chr(10) || 'Born ' || low || ' - ' || high END || CASE WHEN n <= 5 THEN chr(10) || people ELSE '' END AS tooltip FROM (
    SELECT CAST(person_id // 3 % 997 AS FLOAT) AS latitude, arg_min(coalesce(nullif(location_name, ''), nullif(city, ''), nullif(state, ''), 'Unknown'), person_id) AS label, count(*) AS n, min(birth_year) AS low, max(birth_year) AS high,
    string_agg(coalesce({_PERSON_NAME}, 'Unknown') || CASE WHEN birth_year IS NULL THEN '' ELSE ' (' || birth_year || ')' END, chr(10) ORDER BY person_id) AS people FROM located GROUP BY 1)""", more=_BY_KEY))  # fmt: skip
def map_tooltips(spark: SparkSession, d: str) -> DataFrame:
    rows = geo.located(fx.persons(spark, d), fx.locations(spark, d)).withColumns({"latitude": F.floor(F.col("person_id") / 3 % 997).cast("float"), "longitude": F.lit(0.0)})
    c = geo.clusters(rows)
    return c.select("latitude", text.tooltip(*map(F.col, ("location_name", "person_count", "min_year", "max_year", "persons"))).alias("tooltip"))


@published(_points_sql("WHERE birth_year IS NULL OR birth_year >= 1996"))
def map_clusters_min_year(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d, 1996)


@published(_points_sql("WHERE birth_year IS NULL OR birth_year <= 1996"))
def map_clusters_max_year(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d, None, 1996)


@published(with_fixtures("persons locations", "SELECT coalesce(min(birth_year), 1700) AS min_year, coalesce(max(birth_year), 1900) AS max_year FROM located", more=_BY_KEY))
def map_year_range(spark: SparkSession, d: str) -> DataFrame:
    return geo.year_range(geo.located(fx.persons(spark, d), fx.locations(spark, d)))


@published(_points_sql(select="SELECT id, min_year FROM points WHERE min_year <= 1995"))
def map_visible_1995(spark: SparkSession, d: str) -> DataFrame:
    return geo.visible(_points(spark, d), 1995).select("id", "min_year")


@published(_points_sql(select="""SELECT id, radius, CASE WHEN min_year IS NULL OR 1998 - min_year < 0 THEN 'gray' WHEN 1998 - min_year < 20 THEN 'green' WHEN 1998 - min_year < 50 THEN 'blue' ELSE 'purple' END AS colour,
    CASE WHEN person_count > 3 THEN greatest(8.0::DOUBLE, radius * 0.8::DOUBLE) END AS font FROM (SELECT *, greatest(4.0::DOUBLE, least(20.0::DOUBLE, sqrt(person_count) * 3)) AS radius FROM points)"""))  # fmt: skip
def marker_style(spark: SparkSession, d: str) -> DataFrame:
    n, r = F.col("person_count"), F.col("radius")
    p = _points(spark, d).withColumn("radius", text.marker_radius(n))
    return p.select("id", "radius", text.marker_colour(F.lit(1998), F.col("min_year")).alias("colour"), text.marker_label(n, r).alias("font"))


@published(_points_sql(select="SELECT CAST(year AS INTEGER) AS year, (SELECT count(*) FROM points WHERE min_year <= year) AS n_clusters, (SELECT CAST(coalesce(sum(person_count), 0) AS BIGINT) FROM points WHERE min_year <= year) AS n_persons FROM (SELECT unnest(range(1990, 2011, 5)) AS year)"))
def time_frames(spark: SparkSession, d: str) -> DataFrame:
    return geo.frames(_points(spark, d), 1990, 2010)


# --- scalars ---------------------------------------------------------------------------------------------------------


@published("SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '([0-9]{4})', 1), '') AS INTEGER) AS year FROM documents")
def parse_year(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.parse_year(F.col("text")).alias("year"))


@published(with_fixtures("persons", "SELECT id, nullif(regexp_extract(birth_date, '^([0-9]{4})', 1), '') AS year FROM persons"))
def year_start(spark: SparkSession, d: str) -> DataFrame:
    return fx.persons(spark, d).select("id", text.year_start(F.col("birth_date")).alias("year"))


@published(f"SELECT p_partkey, {key_sql('spelling')} AS location_key FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '  ' || p_name || ' ,' || p_type || ' .;' WHEN 1 THEN upper(p_name) || E'\\t, ' || p_type WHEN 2 THEN ',,' ELSE replace(p_name, ' ', '   ') END AS spelling FROM part)")
def location_key(spark: SparkSession, d: str) -> DataFrame:
    k, n, t = F.col("p_partkey") % 4, F.col("p_name"), F.col("p_type")
    spelling = F.when(k == 0, F.concat(F.lit("  "), n, F.lit(" ,"), t, F.lit(" .;"))).when(k == 1, F.concat(F.upper(n), F.lit("\t, "), t)).when(k == 2, ",,").otherwise(F.replace(n, F.lit(" "), F.lit("   ")))
    return table(spark, d, "part").select("p_partkey", text.location_key(spelling).alias("location_key"))


@published(with_fixtures("persons", "SELECT id, coalesce(nullif(concat_ws(' ', nullif(first_name, ''), nullif(middle_name, ''), coalesce(nullif(last_name_birth, ''), nullif(last_name_current, '')), nullif(suffix, '')), ''), nullif(wiki_id, ''), 'Unknown') AS full_name FROM persons"))
def full_name(spark: SparkSession, d: str) -> DataFrame:
    return fx.persons(spark, d).select("id", text.full_name(*map(F.col, ("first_name", "middle_name", "last_name_birth", "last_name_current", "suffix", "wiki_id"))).alias("full_name"))


@published(with_fixtures("persons", "SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN name WHEN id % 3 = 1 THEN NULL ELSE NULL END, nullif(concat_ws(' ', nullif(CASE WHEN id % 4 > 0 THEN first_name END, ''), nullif(middle_name, ''), nullif(last_name_birth, '')), ''), wiki_id) AS display_name FROM persons"))
def display_name(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("id") % 3 == 0, F.col("name")).when(F.col("id") % 3 == 1, "")
    first = F.when(F.col("id") % 4 > 0, F.col("first_name"))
    return fx.persons(spark, d).select("id", text.display_name(name, first, F.col("middle_name"), F.col("last_name_birth"), F.col("wiki_id")).alias("display_name"))


@published(with_fixtures("persons", "SELECT id, concat_ws(' - ', nullif(birth_date, ''), nullif(death_date, '')) AS lifespan FROM persons"))
def lifespan(spark: SparkSession, d: str) -> DataFrame:
    return fx.persons(spark, d).select("id", text.lifespan(F.col("birth_date"), F.col("death_date")).alias("lifespan"))


@published(with_fixtures("persons", "SELECT id, CASE gender WHEN 'Male' THEN 'M' WHEN 'Female' THEN 'F' ELSE 'U' END AS gender FROM persons"))
def gender_code(spark: SparkSession, d: str) -> DataFrame:
    return fx.persons(spark, d).select("id", text.gender_code(F.col("gender")).alias("gender"))


@published("SELECT p_partkey, CASE WHEN length(p_name) <= 10 THEN p_name ELSE left(p_name, 7) || '...' END AS name FROM part")
def truncate_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.truncate_text(F.col("p_name"), 70, 12).alias("name"))


@published("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 50 > 0.6 THEN 'full' WHEN l_quantity / 50 > 0.25 THEN 'medium' ELSE 'minimal' END AS detail FROM lineitem")
def detail_level(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.detail_level(F.col("l_quantity") / 50).alias("detail"))


@published("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey <> 0")
def valid_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").where(text.valid_id(F.col("o_custkey")))


@published("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders")
def wikitree_date(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, "0000-00-00").when(k % 3 == 1, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", text.profile_date(raw).alias("date"))


@published("SELECT count(*) AS n FROM customer WHERE regexp_matches(replace(c_name, '#', '-'), '^[A-Za-z]+-[0-9]+$')")
def start_id_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where(text.start_id_format(F.replace(F.col("c_name"), F.lit("#"), F.lit("-")))).agg(F.count("*").alias("n"))


@published("SELECT c_custkey, concat_ws(',', '0', CASE WHEN c_custkey > 0 THEN CAST(c_custkey AS VARCHAR) END, CAST(c_custkey + 10000 AS VARCHAR), '4294967294', 'b', '4294967295', '007', 'a') AS ids FROM customer")
def extract_ids_object(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    key = lambda x: F.concat(F.lit('"'), x.cast("string"), F.lit('":{"Id":1},'))
    doc = F.concat(F.lit('{"b":null,'), key(k + 10000), F.lit('"4294967295":1,"4294967294":{},'), F.when(k > 0, key(k)).otherwise(""), F.lit('"007":[],"a":{"Name":"x"},"0":0}'))
    return table(spark, d, "customer").select("c_custkey", F.array_join(ids.extract_ids(doc), ",").alias("ids"))


@published("SELECT c_custkey, c_name || ',tail' AS ids FROM customer")
def extract_ids_array(spark: SparkSession, d: str) -> DataFrame:
    doc = F.concat(F.lit('[{"Name":"'), F.col("c_name"), F.lit('"},null,"text",7,{"Id":1},{"Name":"tail"}]'))
    return table(spark, d, "customer").select("c_custkey", F.array_join(ids.extract_ids(doc), ",").alias("ids"))


# --- graph and layout ------------------------------------------------------------------------------------------------

_SPOUSES = """couples AS (SELECT DISTINCT father_wiki_id AS f, mother_wiki_id AS m FROM persons WHERE father_wiki_id IN (SELECT wiki_id FROM persons) AND mother_wiki_id IN (SELECT wiki_id FROM persons) AND father_wiki_id <> mother_wiki_id),
    pairs AS (SELECT f AS a, m AS b FROM couples UNION SELECT m, f FROM couples)"""
_COUNTS = "counts AS (SELECT parent AS wiki_id, count(DISTINCT child) AS n_children FROM edges JOIN persons p ON p.wiki_id = parent GROUP BY parent)"
#: A drawing's input: nodes with a generation and a place in it. The place is by id, so that SQL can say the rest exactly.
_PLACED = """nodes AS (SELECT generation AS gen, wiki_id, row_number() OVER (PARTITION BY generation ORDER BY id) - 1 AS pos FROM persons),
    look AS (SELECT n.*, lead(wiki_id) OVER (PARTITION BY gen ORDER BY pos) AS next FROM nodes n),
    steps AS (SELECT l.*, 180.0::DOUBLE + CASE WHEN p.a IS NULL THEN 40 ELSE 20 END AS step FROM look l LEFT JOIN pairs p ON p.a = l.wiki_id AND p.b = l.next),
    placed AS (SELECT gen, wiki_id, pos, coalesce(sum(step) OVER (PARTITION BY gen ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS x, gen * 170.0::DOUBLE AS y FROM steps)"""


def _placed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = fx.persons(spark, d)
    nodes = layout.places(p.select(F.col("generation").alias("gen"), "wiki_id", "id"), "id").drop("id")
    pairs = graph.spouses(p)
    return p, pairs, layout.linear_x(nodes, pairs)


@published(with_fixtures("persons", "SELECT a, b FROM pairs", more=_SPOUSES))
def spouse_pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.spouses(fx.persons(spark, d))


@published(with_fixtures("persons edges", "SELECT wiki_id, n_children FROM counts", more=_COUNTS))
def child_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.child_counts(fx.persons(spark, d))


@published(with_fixtures("persons edges", """SELECT p.wiki_id, coalesce((SELECT string_agg(parent, ',' ORDER BY role) FROM edges e JOIN persons q ON q.wiki_id = e.parent WHERE e.child = p.wiki_id), '') AS parents,
    coalesce((SELECT string_agg(c.wiki_id, ',' ORDER BY c.id) FROM persons c WHERE c.father_wiki_id = p.wiki_id OR c.mother_wiki_id = p.wiki_id), '') AS children,
    coalesce((SELECT string_agg(b, ',' ORDER BY b) FROM pairs WHERE a = p.wiki_id), '') AS spouses FROM persons p""", more=_SPOUSES))  # fmt: skip
def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(fx.persons(spark, d)).select("wiki_id", *[F.array_join(c, ",").alias(c) for c in ("parents", "children", "spouses")])


@published()
def bfs_generation(spark: SparkSession, d: str) -> DataFrame:
    return graph.generations(fx.persons(spark, d), ROOT)


@published(with_fixtures("persons", "SELECT generation AS gen, count(*) AS n, min(wiki_id) AS first, max(wiki_id) AS last FROM persons GROUP BY 1"))
def generation_sizes(spark: SparkSession, d: str) -> DataFrame:
    return fx.persons(spark, d).groupBy(F.col("generation").alias("gen")).agg(F.count("*").alias("n"), F.min("wiki_id").alias("first"), F.max("wiki_id").alias("last"))


@published(with_fixtures("persons", "SELECT gen, wiki_id, pos, x, y FROM placed", more=f"{_SPOUSES}, {_PLACED}"))
def linear_x(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d)[2].select("gen", "wiki_id", F.col("pos").cast("long").alias("pos"), "x", "y")


_CROWDED = """crowded AS (SELECT gen, wiki_id, pos, x * 0.7 AS x FROM placed), near AS (SELECT c.*, lead(wiki_id) OVER (PARTITION BY gen ORDER BY x, pos) AS next FROM crowded c),
    gaps AS (SELECT n.*, 180.0::DOUBLE + CASE WHEN p.a IS NULL THEN 40 ELSE 20 END AS step FROM near n LEFT JOIN pairs p ON p.a = n.wiki_id AND p.b = n.next),
    sums AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY gen ORDER BY x, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS s FROM gaps)"""


@published(with_fixtures("persons", "SELECT gen, wiki_id, round(s + max(x - s) OVER (PARTITION BY gen ORDER BY x, pos ROWS UNBOUNDED PRECEDING), 3) AS x FROM sums", more=f"{_SPOUSES}, {_PLACED}, {_CROWDED}"))
def resolve_overlaps(spark: SparkSession, d: str) -> DataFrame:
    _, pairs, placed = _placed(spark, d)
    return layout.resolve_overlaps(placed.withColumn("x", F.col("x") * 0.7), pairs).select("gen", "wiki_id", F.round("x", 3).alias("x"))


@published(with_fixtures("persons edges", """SELECT DISTINCT parent || '->' || child AS id, parent AS source, child AS target, p.x + 90 AS from_x, p.y + 70 AS from_y, c.x + 90 AS to_x, c.y AS to_y
    FROM edges JOIN placed p ON p.wiki_id = parent JOIN placed c ON c.wiki_id = child""", more=f"{_SPOUSES}, {_PLACED}"))  # fmt: skip
def edges_parent_child(spark: SparkSession, d: str) -> DataFrame:
    p, _, placed = _placed(spark, d)
    e = layout.parent_child_edges(placed, graph.present_edges(p))
    return e.select("id", "source", "target", F.col("points")[0]["x"].alias("from_x"), F.col("points")[0]["y"].alias("from_y"), F.col("points")[3]["x"].alias("to_x"), F.col("points")[3]["y"].alias("to_y"))


@published(with_fixtures("persons", """SELECT a || '<=>' || b AS id, a AS source, b AS target, CASE WHEN p.x < q.x THEN p.x ELSE q.x END + 180 AS from_x, CASE WHEN p.x < q.x THEN q.x ELSE p.x END AS to_x
    FROM pairs JOIN placed p ON p.wiki_id = a JOIN placed q ON q.wiki_id = b WHERE a < b""", more=f"{_SPOUSES}, {_PLACED}"))  # fmt: skip
def edges_spouse(spark: SparkSession, d: str) -> DataFrame:
    _, pairs, placed = _placed(spark, d)
    e = layout.spouse_edges(placed, pairs)
    return e.select("id", "source", "target", F.col("points")[0]["x"].alias("from_x"), F.col("points")[1]["x"].alias("to_x"))


@published(with_fixtures("persons", "SELECT min(x) AS min_x, min(y) AS min_y, max(x + 180) AS max_x, max(y + 70) AS max_y FROM placed", more=f"{_SPOUSES}, {_PLACED}"))
def layout_bounds(spark: SparkSession, d: str) -> DataFrame:
    return layout.bounds(_placed(spark, d)[2])


_WINDOW = (500.0, 100.0, 2500.0, 600.0)
_INSIDE = "x <= 2500 AND x + 180 >= 500 AND y <= 600 AND y + 70 >= 100"


@published(with_fixtures("persons", f"SELECT wiki_id, x, y FROM placed WHERE {_INSIDE}", more=f"{_SPOUSES}, {_PLACED}"))
def rect_query(spark: SparkSession, d: str) -> DataFrame:
    return spatial.rect_query(spatial.boxes(_placed(spark, d)[2], cell=1000), *_WINDOW, cell=1000).select("wiki_id", "x", "y")


@published(with_fixtures("persons", "SELECT wiki_id, x, y FROM placed WHERE x <= 950 AND x + 180 >= 950 AND y <= 200 AND y + 70 >= 200 ORDER BY wiki_id LIMIT 1", more=f"{_SPOUSES}, {_PLACED}"))
def point_query(spark: SparkSession, d: str) -> DataFrame:
    return spatial.point_query(spatial.boxes(_placed(spark, d)[2]), 950, 200).select("wiki_id", "x", "y")


#: Boxes of all line items: their price and their ship date.
_BOXES = "SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_extendedprice AS DOUBLE) AS min_x, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS min_y, CAST(l_extendedprice AS DOUBLE) + 180 AS max_x, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) + 70 AS max_y FROM lineitem"
_PRICES = (20000.0, 1400.0, 21000.0, 1500.0)
_TOUCHED = "min_x <= {2} AND max_x >= {0} AND min_y <= {3} AND max_y >= {1}"


def _packed(spark: SparkSession, d: str) -> spatial_index.SpatialIndex:
    """The line items' boxes, packed once for all windows of an application."""

    def boxed() -> DataFrame:
        day = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
        return spatial.boxes(table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").cast("double").alias("x"), day.cast("double").alias("y"))).drop("x", "y")

    return spatial_index.kept(spark, d, boxed, rows=20_000)


@published(f"SELECT sum(1) AS boxes, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM ({_BOXES})")
def packed_tiles(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).tiles().agg(F.sum("n").alias("boxes"), F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


@published(f"SELECT id, min_x, min_y FROM ({_BOXES}) WHERE {_TOUCHED.format(*_PRICES)}")
def packed_rect_query(spark: SparkSession, d: str) -> DataFrame:
    return spatial_index.window(_packed(spark, d), *_PRICES).select("id", "min_x", "min_y")


@published(f"SELECT id, min_x, min_y FROM ({_BOXES}) WHERE {_TOUCHED.format(30000, 1900, 30000, 1900)} ORDER BY id LIMIT 1")
def packed_point_query(spark: SparkSession, d: str) -> DataFrame:
    return spatial_index.at_point(_packed(spark, d), 30000.0, 1900.0, "id").select("id", "min_x", "min_y")


@published(f"SELECT id, id = 11 AS is_selected, id % 10 = 1 AND id < 4000 AS is_highlighted FROM ({_BOXES}) WHERE {_TOUCHED.format(*_PRICES)}")
def packed_visible_nodes(spark: SparkSession, d: str) -> DataFrame:
    shown = spatial_index.window(_packed(spark, d), *_PRICES)
    return spatial.flagged(shown, 11, [10 * k + 1 for k in range(400)], key="id").select("id", "is_selected", "is_highlighted")


@published(f"SELECT w, id FROM ({_BOXES}) JOIN (SELECT n_nationkey AS w, n_nationkey * 3000.0 AS x1, n_nationkey * 90.0 AS y1 FROM nation) ON min_x <= x1 + 300 AND max_x >= x1 AND min_y <= y1 + 40 AND max_y >= y1")
def packed_windows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    asked = table(spark, d, "nation").select(k.alias("w"), (k * 3000.0).alias("x1"), (k * 90.0).alias("y1"), (k * 3000.0 + 300).alias("x2"), (k * 90.0 + 40).alias("y2"))
    return spatial_index.windows(_packed(spark, d), asked).select("w", "id")


@published(with_fixtures("persons edges", f"""SELECT DISTINCT parent || '->' || child AS id, parent AS source, child AS target FROM edges JOIN placed p ON p.wiki_id = parent JOIN placed c ON c.wiki_id = child
    WHERE parent IN (SELECT wiki_id FROM placed WHERE {_INSIDE}) OR child IN (SELECT wiki_id FROM placed WHERE {_INSIDE})""", more=f"{_SPOUSES}, {_PLACED}"))  # fmt: skip
def visible_edges(spark: SparkSession, d: str) -> DataFrame:
    p, _, placed = _placed(spark, d)
    return spatial.visible_edges(layout.parent_child_edges(placed, graph.present_edges(p)), spatial.rect_query(spatial.boxes(placed), *_WINDOW)).select("id", "source", "target")


@published(with_fixtures("persons", """SELECT round((min_x + (max_x - min_x) / 2) - 1200 / scale / 2, 3) AS x, round((min_y + (max_y - min_y) / 2) - 800 / scale / 2, 3) AS y, scale FROM (SELECT *, greatest(0.05::DOUBLE, least(2.0::DOUBLE, least(1200 / (max_x - min_x + 100), 800 / (max_y - min_y + 100)))) AS scale
    FROM (SELECT min(x) AS min_x, min(y) AS min_y, max(x + 180) AS max_x, max(y + 70) AS max_y FROM placed))""", more=f"{_SPOUSES}, {_PLACED}"))  # fmt: skip
def viewport_fit(spark: SparkSession, d: str) -> DataFrame:
    return spatial.fit(layout.bounds(_placed(spark, d)[2]), 1200, 800).select(F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "scale")


@published("SELECT c_custkey, x + 600 / s AS world_x, (c_acctbal - x) * s AS screen_x, x + 300 / s - 300 / greatest(0.05::DOUBLE, least(2.0::DOUBLE, s * 1.1::DOUBLE)) AS zoomed_x, x - 10 / s AS panned_x, x + 1200 / s AS max_x FROM (SELECT c_custkey, c_acctbal, c_custkey::DOUBLE AS x, (c_custkey % 40 + 1) / 20.0::DOUBLE AS s FROM customer)")
def viewport_math(spark: SparkSession, d: str) -> DataFrame:
    x, s, y = F.col("c_custkey").cast("double"), (F.col("c_custkey") % 40 + 1) / F.lit(20.0), F.lit(0.0)
    return table(spark, d, "customer").select(
        "c_custkey", spatial.to_world(F.lit(600), y, x, y, s)["world_x"].alias("world_x"), spatial.to_screen(F.col("c_acctbal"), y, x, y, s)["screen_x"].alias("screen_x"),
        spatial.zoom_at(x, y, s, F.lit(300), y, closer=True)["x"].alias("zoomed_x"), spatial.pan(x, y, s, F.lit(10), y)["x"].alias("panned_x"), spatial.visible_bounds(x, y, s, 1200, 800)["max_x"].alias("max_x"),
    )


@published()
def tree_layout(spark: SparkSession, d: str) -> DataFrame:
    return layout.layout(fx.persons(spark, d), ROOT).select("gen", "wiki_id", "unit", "x", "y")


@published("SELECT c_custkey AS id, CAST(0 AS INTEGER) AS segment, CAST(n AS INTEGER) AS nth, n * 10.0::DOUBLE AS x1, least(w, n * 10 + 6)::DOUBLE AS x2, 0.0::DOUBLE AS y1, 0.0::DOUBLE AS y2 FROM (SELECT c_custkey, c_custkey % 40 AS w, unnest(range(5)) AS n FROM customer) WHERE n * 10 < w UNION ALL SELECT c_custkey, 1, CAST(n AS INTEGER), w, w, n * 10.0::DOUBLE, least(20, n * 10 + 6)::DOUBLE FROM (SELECT c_custkey, c_custkey % 40 AS w, unnest(range(2)) AS n FROM customer)")
def edge_dashes(spark: SparkSession, d: str) -> DataFrame:
    w = (F.col("c_custkey") % 40).cast("double")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    edges = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array(point(F.lit(0.0), F.lit(0.0)), point(w, F.lit(0.0)), point(w, F.lit(20.0))).alias("points"))
    return spatial.dashes(edges)


@published("""SELECT c_custkey AS id, CAST(nth AS INTEGER) AS nth, kind, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (
    SELECT c_custkey, 0 AS nth, 'line' AS kind, c_custkey AS x, 0 AS y FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 0, 'quadratic', c_custkey, 10 FROM customer WHERE c_custkey % 3 = 1
    UNION ALL SELECT c_custkey, 1, 'line', c_custkey, 20 FROM customer WHERE c_custkey % 3 = 1 UNION ALL SELECT c_custkey, 0, 'cubic', 0, 20 FROM customer WHERE c_custkey % 3 = 2)""")  # fmt: skip
def edge_curves(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("double")
    point = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    points = F.array(point(F.lit(0.0), 0.0), point(k, 0.0), point(k, 20.0), point(F.lit(0.0), 20.0))
    edges = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.slice(points, 1, (F.col("c_custkey") % 3 + 2).cast("int")).alias("points"))
    drawn = spatial.curves(edges).withColumn("last", F.element_at("points", -1))
    return drawn.select("id", "nth", "kind", F.col("last.x").alias("x"), F.col("last.y").alias("y"))


@published(with_fixtures("persons", "SELECT wiki_id, CASE WHEN id % 7 = 0 THEN 'selected' WHEN gender = 'Male' THEN 'male' WHEN gender = 'Female' THEN 'female' ELSE 'unknown' END AS colour FROM persons"))
def node_colours(spark: SparkSession, d: str) -> DataFrame:
    return fx.persons(spark, d).select("wiki_id", text.node_colour(F.col("id") % 7 == 0, text.gender_code(F.col("gender"))).alias("colour"))


@published("SELECT 'P-' || o_custkey AS wiki_id, arg_max(o_orderstatus, o_orderkey) AS status, min(o_orderkey) AS pos FROM orders GROUP BY o_custkey")
def latest_nodes(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "orders").select(F.concat(F.lit("P-"), F.col("o_custkey").cast("string")).alias("wiki_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("pos"))
    return graph.nodes(raw)


# --- queue and ingest ------------------------------------------------------------------------------------------------


@published(with_fixtures("crawl_queue", "SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'error') AS error FROM crawl_queue"))
def queue_stats(spark: SparkSession, d: str) -> DataFrame:
    return queue.stats(fx.crawl_queue(spark, d))


@published(with_fixtures("crawl_queue", "SELECT id, wiki_id, priority FROM crawl_queue WHERE status = 'pending' ORDER BY priority DESC NULLS FIRST, created_at NULLS LAST, id LIMIT 1"))
def queue_next(spark: SparkSession, d: str) -> DataFrame:
    return queue.dequeue(fx.crawl_queue(spark, d)).select("id", "wiki_id", "priority")


@published(with_fixtures("crawl_queue", "SELECT wiki_id, arg_min(priority, seq) AS priority, 'pending' AS status FROM (SELECT 'P-' || o_custkey AS wiki_id, CAST(o_orderkey % 7 AS INTEGER) AS priority, o_orderkey AS seq FROM orders) WHERE wiki_id NOT IN (SELECT wiki_id FROM crawl_queue) GROUP BY wiki_id"))
def queue_enqueue_ignore(spark: SparkSession, d: str) -> DataFrame:
    batch = table(spark, d, "orders").select(F.concat(F.lit("P-"), F.col("o_custkey").cast("string")).alias("wiki_id"), (F.col("o_orderkey") % 7).cast("int").alias("priority"), F.col("o_orderkey").alias("seq"))
    return queue.enqueue(fx.crawl_queue(spark, d), batch).select("wiki_id", "priority", "status")


_BATCH = "SELECT 'P-' || o_custkey AS wiki_id, CAST(o_orderkey % 7 AS INTEGER) AS priority, o_orderkey AS seq FROM orders"


def _batch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.concat(F.lit("P-"), F.col("o_custkey").cast("string")).alias("wiki_id"), (F.col("o_orderkey") % 7).cast("int").alias("priority"), F.col("o_orderkey").alias("seq"))


@published(with_fixtures("crawl_queue", f"SELECT wiki_id, arg_min(priority, seq) AS priority FROM ({_BATCH}) WHERE wiki_id NOT IN (SELECT wiki_id FROM crawl_queue WHERE status <> 'processing') AND wiki_id NOT IN (SELECT wiki_id FROM crawl_queue WHERE status = 'processing') GROUP BY wiki_id"))
def queue_enqueue_in_flight(spark: SparkSession, d: str) -> DataFrame:
    q = fx.crawl_queue(spark, d)
    return queue.enqueue(q.where("status <> 'processing'"), _batch(spark, d), q.where("status = 'processing'")).select("wiki_id", "priority")


@published(with_fixtures("crawl_queue", f"SELECT count(*) AS attempted FROM ({_BATCH}) WHERE wiki_id NOT IN (SELECT wiki_id FROM crawl_queue WHERE status = 'processing')"))
def queue_enqueue_attempted(spark: SparkSession, d: str) -> DataFrame:
    q = fx.crawl_queue(spark, d)
    return queue.enqueue_batch(q, _batch(spark, d), q.where("status = 'processing'"))[1]


@published(with_fixtures("crawl_queue", "SELECT id, CASE WHEN id IN (SELECT id FROM crawl_queue WHERE status = 'pending' ORDER BY priority DESC NULLS FIRST, created_at NULLS LAST, id LIMIT 5) THEN 'processing' ELSE status END AS status FROM crawl_queue"))
def queue_take(spark: SparkSession, d: str) -> DataFrame:
    return queue.take(fx.crawl_queue(spark, d), 5)[1].select("id", "status")


@published(with_fixtures("crawl_queue", "SELECT count(*) AS reset FROM crawl_queue WHERE status = 'processing'"))
def reset_count(spark: SparkSession, d: str) -> DataFrame:
    return queue.reset_processing(fx.crawl_queue(spark, d))[1]


@published("""SELECT 'P-' || user_id AS wiki_id, max(ts) FILTER (event_type IN ('error', 'completed')) AS processed_at FROM events GROUP BY user_id""")
def queue_processed_at(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.concat(F.lit("P-"), F.col("user_id").cast("string")).alias("wiki_id"), F.struct("ts", "event_id").alias("seq"), F.col("event_type").alias("event"), F.col("props").alias("message"), F.col("ts").alias("at"))
    return queue.fold_events(e).select("wiki_id", "processed_at")


@published("""SELECT 'P-' || user_id AS wiki_id, arg_max(event_type, event_id) AS status, CAST(count(*) FILTER (event_type = 'error') AS INTEGER) AS retry_count, arg_max(props, event_id) FILTER (event_type = 'error') AS error_message FROM events GROUP BY user_id""")
def queue_event_fold(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.concat(F.lit("P-"), F.col("user_id").cast("string")).alias("wiki_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("event"), F.col("props").alias("message"), F.col("ts").alias("at"))
    return queue.fold_events(e).select("wiki_id", "status", "retry_count", "error_message")


@published(with_fixtures("crawl_queue", "SELECT id, wiki_id, CASE status WHEN 'processing' THEN 'pending' ELSE status END AS status FROM crawl_queue"))
def reset_processing(spark: SparkSession, d: str) -> DataFrame:
    return queue.reset_processing(fx.crawl_queue(spark, d))[0].select("id", "wiki_id", "status")


@published(with_fixtures("crawl_queue", "SELECT wiki_id, CASE WHEN status = 'completed' THEN 'completed' ELSE 'pending' END AS status FROM crawl_queue"))
def import_queue_unvisited(spark: SparkSession, d: str) -> DataFrame:
    q = fx.crawl_queue(spark, d)
    return queue.import_queue(q.select("wiki_id", F.col("id").alias("seq")), q.where("status = 'completed'"))


_SOURCE_SQL = "source AS (SELECT 'P-' || o_custkey AS wiki_id, o_orderkey AS seq, o_orderpriority AS name, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS suffix FROM orders)"


def _source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.concat(F.lit("P-"), F.col("o_custkey").cast("string")).alias("wiki_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("suffix")
    )


@published(with_fixtures("persons", "SELECT p.id, wiki_id, CASE WHEN n.wiki_id IS NULL THEN p.name ELSE n.name END AS name, CASE WHEN n.wiki_id IS NULL THEN p.suffix ELSE n.suffix END AS suffix, p.generation FROM persons p FULL JOIN (SELECT * FROM source QUALIFY row_number() OVER (PARTITION BY wiki_id ORDER BY seq DESC) = 1) n USING (wiki_id)", more=_SOURCE_SQL))
def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return ingest.upsert(fx.persons(spark, d), _source(spark, d)).select("id", "wiki_id", "name", "suffix", "generation")


@published(with_fixtures("persons", "SELECT p.id, wiki_id, coalesce(n.name, p.name) AS name, coalesce(n.suffix, p.suffix) AS suffix FROM persons p FULL JOIN (SELECT wiki_id, arg_max(name, seq) AS name, arg_max(suffix, seq) FILTER (suffix IS NOT NULL) AS suffix FROM source GROUP BY wiki_id) n USING (wiki_id)", more=_SOURCE_SQL))
def upsert_sparse(spark: SparkSession, d: str) -> DataFrame:
    return ingest.upsert(fx.persons(spark, d), _source(spark, d), merge="coalesce").select("id", "wiki_id", "name", "suffix")


_NOW = "2024-05-06 07:08:09"


@published(with_fixtures("persons", f"""SELECT coalesce(p.id, CAST((SELECT max(id) FROM persons) + row_number() OVER (PARTITION BY p.id IS NULL ORDER BY n.first) AS INTEGER)) AS id, wiki_id, CASE WHEN n.wiki_id IS NULL THEN p.name ELSE n.name END AS name, CASE WHEN n.wiki_id IS NULL THEN p.suffix ELSE n.suffix END AS suffix, p.generation, CASE WHEN n.wiki_id IS NULL THEN '' ELSE '{_NOW}' END AS updated_at
    FROM persons p FULL JOIN (SELECT *, min(seq) OVER (PARTITION BY wiki_id) AS first FROM source QUALIFY row_number() OVER (PARTITION BY wiki_id ORDER BY seq DESC) = 1) n USING (wiki_id)""", more="source AS (SELECT 'P-' || (o_custkey + 20) AS wiki_id, o_orderkey AS seq, o_orderpriority AS name, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS suffix FROM orders)"))  # fmt: skip
def versioned_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Persons kept as a versioned table, upserted by key: twenty persons are new."""
    base = kept(spark, "versioned-persons", d, lambda path: versioned_table.create(fx.persons(spark, d).withColumn("updated_at", F.lit(None).cast("timestamp")), path, "wiki_id", buckets=8))
    source = table(spark, d, "orders").select(F.concat(F.lit("P-"), (F.col("o_custkey") + 20).cast("string")).alias("wiki_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("suffix"))
    after = versioned_table.upsert(versioned_table.open_table(spark, base.path), source, now=F.lit(_NOW).cast("timestamp"))
    return after.rows().select("id", "wiki_id", "name", "suffix", "generation", F.coalesce(F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("updated_at"))


@published(with_fixtures("crawl_queue", f"SELECT wiki_id, priority, status FROM crawl_queue UNION ALL SELECT wiki_id, arg_min(priority, seq), 'pending' FROM ({_BATCH}) WHERE wiki_id NOT IN (SELECT wiki_id FROM crawl_queue) GROUP BY wiki_id"))
def versioned_enqueue(spark: SparkSession, d: str) -> DataFrame:
    """The queue kept as a versioned table, with all orders' customers enqueued: known ids are ignored."""
    base = kept(spark, "versioned-queue", d, lambda path: versioned_table.create(fx.crawl_queue(spark, d), path, "wiki_id", buckets=8))
    after, _ = versioned_table.insert_ignore(versioned_table.open_table(spark, base.path), _batch(spark, d).withColumn("status", F.lit("pending")))
    return after.rows().select("wiki_id", "priority", "status")


@published(with_fixtures("persons", """SELECT raw AS raw_location, key AS location_key FROM (SELECT n_name AS raw, CASE WHEN n_nationkey % 3 > 0 THEN lower(n_name) END AS key, n_nationkey * 2 AS seq FROM nation UNION ALL SELECT lower(n_name), lower(n_name), n_nationkey * 2 + 1 FROM nation)
    WHERE raw NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0) QUALIFY key IS NULL OR row_number() OVER (PARTITION BY key ORDER BY seq) = 1"""))  # fmt: skip
def insert_ignore_null_keys(spark: SparkSession, d: str) -> DataFrame:
    """Locations whose text is there without a key: another spelling of the key is still taken."""
    n = F.col("n_nationkey")
    nation = table(spark, d, "nation")
    there = nation.where(n % 2 == 0).select(F.col("n_name").alias("raw_location"), F.lit(None).cast("string").alias("location_key"))
    asked = nation.select(F.col("n_name").alias("raw_location"), F.when(n % 3 > 0, F.lower("n_name")).alias("location_key"), (n * 2).alias("seq")).unionByName(nation.select(F.lower("n_name").alias("raw_location"), F.lower("n_name").alias("location_key"), (n * 2 + 1).alias("seq")))
    return ingest.insert_ignore_locations(there, asked).select("raw_location", "location_key")


@published(with_fixtures("persons locations", """SELECT raw_location, location_key FROM (SELECT birth_location AS raw_location, birth_location_key AS location_key, min(id) AS seq FROM persons WHERE birth_location IS NOT NULL GROUP BY 1, 2)
    WHERE raw_location NOT IN (SELECT raw_location FROM half) AND location_key NOT IN (SELECT location_key FROM half) QUALIFY row_number() OVER (PARTITION BY location_key ORDER BY seq) = 1""", more="half AS (SELECT * FROM locations WHERE id % 2 = 0)"))  # fmt: skip
def insert_ignore_location(spark: SparkSession, d: str) -> DataFrame:
    batch = fx.persons(spark, d).where("birth_location is not null").select(F.col("birth_location").alias("raw_location"), F.col("birth_location_key").alias("location_key"), F.col("id").alias("seq"))
    return ingest.insert_ignore_locations(fx.locations(spark, d).where("id % 2 = 0"), batch).select("raw_location", "location_key")


@published(with_fixtures("persons locations", f"""SELECT min(raw) AS raw_location, location_key FROM (SELECT DISTINCT birth_location AS raw, {key_sql('birth_location')} AS location_key FROM persons WHERE birth_location IS NOT NULL AND birth_location <> '')
    WHERE raw NOT IN (SELECT raw_location FROM locations WHERE id > 5) AND location_key NOT IN (SELECT location_key FROM locations WHERE id > 5) GROUP BY location_key"""))  # fmt: skip
def geocode_todo(spark: SparkSession, d: str) -> DataFrame:
    return ingest.to_geocode(fx.persons(spark, d), fx.locations(spark, d).where("id > 5"))


@published(with_fixtures("persons", f"SELECT id, {key_sql('birth_location')} AS birth_location_key, {key_sql('death_location')} AS death_location_key FROM persons"))
def backfill_keys(spark: SparkSession, d: str) -> DataFrame:
    return ingest.backfill_keys(fx.persons(spark, d)).select("id", "birth_location_key", "death_location_key")


@published(with_fixtures("persons", "SELECT DISTINCT birth_location AS raw_location FROM persons WHERE birth_location IS NOT NULL AND birth_location <> ''"))
def distinct_locations(spark: SparkSession, d: str) -> DataFrame:
    return ingest.distinct_locations(fx.persons(spark, d))


@published(with_fixtures("persons", "SELECT count(DISTINCT birth_location_key) AS n FROM persons"))
def location_count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return fx.persons(spark, d).agg(F.countDistinct("birth_location_key").alias("n"))


@published(with_fixtures("persons", """SELECT wiki_id, CAST(arg_min(priority, (seq, nth)) AS INTEGER) AS priority FROM (
    SELECT 'P-' || (CAST(substr(wiki_id, 3) AS BIGINT) + 1) AS wiki_id, 1 AS priority, id AS seq, 0 AS nth FROM persons UNION ALL
    SELECT 'P-' || (CAST(substr(wiki_id, 3) AS BIGINT) * 2), 0, id, 1 FROM persons UNION ALL
    SELECT father_wiki_id, 2, id, 2 FROM persons UNION ALL SELECT mother_wiki_id, 2, id, 3 FROM persons) WHERE wiki_id IS NOT NULL GROUP BY wiki_id"""))  # fmt: skip
def relatives_priority(spark: SparkSession, d: str) -> DataFrame:
    k = F.substring("wiki_id", 3, 20).cast("long")
    pid = lambda c: F.concat(F.lit("P-"), c.cast("string"))
    p = fx.persons(spark, d).select("wiki_id", F.col("id").alias("seq"), F.array(pid(k + 1)).alias("spouses"), F.array(pid(k * 2)).alias("children"), F.col("father_wiki_id").alias("father"), F.col("mother_wiki_id").alias("mother"))
    return queue.relatives(p, with_parents=True).select("wiki_id", F.col("priority").cast("int").alias("priority"))


@published(with_fixtures("persons relationships", "SELECT person_id, related_person_id, relationship_type FROM relationships WHERE person_id % 10 <> 3 AND related_person_id % 10 <> 3"))
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.schemas import delete_persons

    p = fx.persons(spark, d)
    return delete_persons(p, fx.relationships(spark, d), p.where("id % 10 = 3"))[1]


@published(with_fixtures("persons edges", "SELECT DISTINCT wiki_id FROM reach", True, "reach AS (SELECT 'P-0' AS wiki_id, 0 AS d UNION SELECT child, d + 1 FROM edges JOIN reach ON parent = wiki_id WHERE d < 3)"))
def crawl_closure_rounds(spark: SparkSession, d: str) -> DataFrame:
    links = graph.edges(fx.persons(spark, d)).select(F.col("parent").alias("source"), F.col("child").alias("target"))
    return queue.closure(links, spark.range(1).select(F.lit(ROOT).alias("wiki_id")), max_rounds=3)


@published(with_fixtures("persons edges", "SELECT wiki_id FROM reach", True, "reach AS (SELECT 'P-0' AS wiki_id UNION SELECT child FROM edges JOIN reach ON parent = wiki_id)"))
def crawl_closure(spark: SparkSession, d: str) -> DataFrame:
    p = fx.persons(spark, d)
    links = graph.edges(p).select(F.col("parent").alias("source"), F.col("child").alias("target"))
    return queue.closure(links, spark.range(1).select(F.lit(ROOT).alias("wiki_id")))


# profile documents: fields missing, null, empty and of several types


def _documents(spark: SparkSession, d: str) -> DataFrame:
    k, q = F.col("c_custkey"), lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    living = F.element_at(F.array(*[F.lit(x) for x in ("1", '"1"', "true", "0", "null", "1.0")]), (k % 6 + 1).cast("int"))
    father = F.when(k % 5 == 0, k.cast("string")).when(k % 5 == 1, q(k.cast("string"))).when(k % 5 == 2, '"0"').when(k % 5 == 3, "null").otherwise('""')
    doc = F.concat(
        F.lit('[{"profile":{"Id":'), k.cast("string"), F.when(k % 11 == 0, "").otherwise(F.concat(F.lit(',"Name":'), F.when(k % 11 == 1, '""').otherwise(q(F.concat(F.lit("Name-"), k.cast("string")))))),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(',"FirstName":'), F.when(k % 3 == 1, '""').otherwise(q(F.col("c_mktsegment"))))),
        F.lit(',"LastNameCurrent":'), q(F.col("c_mktsegment")), F.lit(',"BirthLocation":"Berks ,PA.","IsLiving":'), living, F.lit(',"Father":'), father, F.lit(',"Spouses":'), F.when(k % 2 == 0, F.concat(F.lit('{"9":{},"'), k.cast("string"), F.lit('":{}}'))).otherwise("[]"), F.lit("}}]"),
    )
    return profiles.unpack(table(spark, d, "customer").select(k.alias("k"), doc.alias("json")), "profile").drop("nth")


@published("""SELECT c_custkey AS k, 'Name-' || c_custkey AS wiki_id, CAST(c_custkey AS INTEGER) AS wiki_numeric_id, CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment || ' ' ELSE '' END || c_mktsegment AS name, CASE c_custkey % 3 WHEN 1 THEN '' WHEN 2 THEN c_mktsegment END AS first_name,
    'berks, pa' AS birth_location_key, c_custkey % 6 IN (0, 5) AS is_living, CASE WHEN c_custkey % 5 < 2 AND c_custkey > 0 THEN CAST(c_custkey AS VARCHAR) END AS father_wiki_id,
    CASE WHEN c_custkey % 2 = 1 THEN '' WHEN c_custkey = 0 THEN '0,9' WHEN c_custkey < 9 THEN c_custkey || ',9' ELSE '9,' || c_custkey END AS spouses FROM customer WHERE c_custkey % 11 > 1""")  # fmt: skip
def ingest_profiles(spark: SparkSession, d: str) -> DataFrame:
    p = ingest.profiles(_documents(spark, d))
    return p.select("k", "wiki_id", "wiki_numeric_id", "name", "first_name", "birth_location_key", "is_living", "father_wiki_id", F.array_join("spouse_ids", ",").alias("spouses"))


@published("""SELECT 'P-' || c_custkey AS wiki_id, CAST(c_custkey % 9 AS INTEGER) AS generation, CASE c_custkey % 4 WHEN 0 THEN '0' WHEN 1 THEN CAST(c_custkey AS VARCHAR) END AS father_wiki_id, CASE WHEN c_custkey % 3 = 0 THEN '' END AS suffix FROM customer""")
def import_legacy_persons(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    father = F.when(k % 4 == 0, '"0"').when(k % 4 == 1, k.cast("string")).when(k % 4 == 2, '""').otherwise("0")
    doc = F.concat(F.lit('{"generation":'), (k % 9).cast("string"), F.lit(',"father_id":'), father, F.when(k % 3 == 0, ',"suffix":""').otherwise(""), F.lit("}"))
    imported = table(spark, d, "customer").select(F.concat(F.lit("P-"), k.cast("string")).alias("wiki_id"), doc.alias("json"))
    return ingest.legacy_persons(imported).select("wiki_id", "generation", "father_wiki_id", "suffix")


def _gazetteer(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    part = lambda i, t: F.struct(F.lit(i).alias("id"), t.alias("text"))
    context = F.array(part("country.1", F.lit("X")), part("region.1", F.lit("first")), part("region.2", F.col("n_name")), part("place.3", F.lower("n_name")))
    return table(spark, d, "nation").select(F.concat(F.lit("Place "), n.cast("string")).alias("raw_location"), (n * 2.5).alias("latitude"), (n * -1.0).alias("longitude"), F.concat(F.col("n_name"), F.lit(", X")).alias("place_name"), F.when(n % 5 > 0, context).alias("context"))


@published("SELECT 'Place ' || n_nationkey AS raw_location, 'place ' || n_nationkey AS location_key, n_name || ', X' AS normalized_name, CASE WHEN n_nationkey % 5 > 0 THEN 'X' END AS country, CASE WHEN n_nationkey % 5 > 0 THEN n_name END AS state, CASE WHEN n_nationkey % 5 > 0 THEN lower(n_name) END AS city FROM nation WHERE n_nationkey NOT IN (3, 4)")
def geocode_lookup(spark: SparkSession, d: str) -> DataFrame:
    there = spark.createDataFrame([("Place 3", None), ("other", "place 4")], "raw_location string, location_key string")
    raw = table(spark, d, "customer").select(F.concat(F.lit("Place "), (F.col("c_custkey") % 30).cast("string")).alias("raw_location")).unionByName(table(spark, d, "nation").select(F.lit("  ").alias("raw_location")))
    return ingest.geocode_if_needed(there, raw, _gazetteer(spark, d)).select("raw_location", "location_key", "normalized_name", "country", "state", "city")


@published("SELECT c_custkey, c_acctbal - 600 / s AS x, CAST(floor((c_custkey + c_custkey // 2) / 2.0 + 0.5) AS BIGINT) AS slider FROM (SELECT c_custkey, c_acctbal, (c_custkey % 40 + 1) / 20.0::DOUBLE AS s FROM customer)")
def centre_and_slider(spark: SparkSession, d: str) -> DataFrame:
    k, scale = F.col("c_custkey"), (F.col("c_custkey") % 40 + 1) / F.lit(20.0)
    return table(spark, d, "customer").select("c_custkey", spatial.centre_on(F.col("c_acctbal"), F.lit(0.0), scale, 1200, 800)["x"].alias("x"), text.half_up((k + F.floor(k / 2)) / 2).alias("slider"))


@published("SELECT 'orders' AS name, count(*) AS rows, true AS same, true AS differs FROM orders UNION ALL SELECT 'customer', count(*), true, true FROM customer")
def snapshot_checksums(spark: SparkSession, d: str) -> DataFrame:
    """Tables written as a snapshot and read again have its checksums; with one value changed they haven't."""
    from ..sources import snapshots

    tables = {n: table(spark, d, n) for n in ("orders", "customer")}
    path = kept(spark, "snapshot", d, lambda path: snapshots.export(tables, path))["path"]
    found, rows = snapshots.manifest(spark, path), []
    for name, column in (("orders", "o_totalprice"), ("customer", "c_acctbal")):
        again = spark.read.parquet(f"{path}/{name}").repartition(3)
        n, sums = snapshots.checksums(again)
        key = again.columns[0]
        changed = again.withColumn(column, F.when(F.col(key) == 7, F.col(column) + 1).otherwise(F.col(column)))
        rows.append((name, n, sums == found["checksums"][name], snapshots.checksums(changed)[1] != sums))
    return spark.createDataFrame(rows, "name string, rows long, same boolean, differs boolean")


@published(with_fixtures("persons", f"SELECT id, birth_location AS raw_location, CASE WHEN id = min(id) OVER (PARTITION BY key) THEN key END AS location_key FROM (SELECT *, {key_sql('birth_location')} AS key FROM persons)"))
def location_key_backfill(spark: SparkSession, d: str) -> DataFrame:
    return ingest.backfill_location_keys(fx.persons(spark, d).select("id", F.col("birth_location").alias("raw_location"), F.lit("old").alias("location_key")))


@published("SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H-%M-%S') AS stamp, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y:%m:%d %H:%M:%S') AS shown, round(o_totalprice / 1024 / 1024, 2) AS mb, 'https://h.example/wiki/P-' || o_custkey AS link FROM orders")
def stamps_and_links(spark: SparkSession, d: str) -> DataFrame:
    stamp = text.backup_stamp(F.col("o_orderdate").cast("timestamp"))
    return table(spark, d, "orders").select("o_orderkey", stamp.alias("stamp"), text.parse_backup_stamp(stamp).alias("shown"), text.megabytes(F.col("o_totalprice")).alias("mb"), text.person_link("https://h.example", F.concat(F.lit("P-"), F.col("o_custkey").cast("string"))).alias("link"))

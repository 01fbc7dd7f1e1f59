"""Family-history tables derived from the driver's tables, in Spark and, for the oracle, as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import location_key

ROOT = "P-0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pid(c) -> F.Column:
    return F.concat(F.lit("P-"), c.cast("string"))


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, j, jp = F.col("c_custkey"), F.floor(F.col("c_custkey") / 2), F.floor((F.floor(F.col("c_custkey") / 2) - 1) / 3)
    year = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.year("o_orderdate")).cast("string").alias("y"))
    inside, far = (k % 2 == 0) & (k > 0), (j % 10 == 0) & (jp + 1 < j)
    place = F.when(k % 3 == 0, F.concat_ws(", ", "n_name", "r_name")).when(k % 3 == 1, F.concat_ws(" ,  ", F.upper("n_name"), "r_name")).otherwise(F.concat(F.lit("  "), F.lower(F.concat_ws(",", "n_name", "r_name")), F.lit(".")))
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        table(spark, sf_dir, "customer").join(year, "c_custkey", "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            (k + 1).cast("int").alias("id"), _pid(k).alias("wiki_id"), (k + 1000).cast("int").alias("wiki_numeric_id"), F.col("c_name").alias("name"),
            F.initcap("c_mktsegment").alias("first_name"), F.when(k % 5 == 0, "").when(k % 5 == 1, "Q").alias("middle_name"), F.when(k % 7 != 0, F.concat(F.lit("Line"), (k % 40).cast("string"))).alias("last_name_birth"),
            F.concat(F.lit("House"), (k % 11).cast("string")).alias("last_name_current"), F.when(k % 23 == 0, "Jr").alias("suffix"),
            F.when(k % 17 == 0, None).when(k % 2 == 0, "Male").otherwise("Female").alias("gender"),
            F.when(k % 3 == 0, F.col("y")).when(k % 3 == 1, F.concat(F.lit("about "), F.col("y"))).otherwise(F.concat("y", F.lit("-05-28"))).alias("birth_date"),
            F.when(k % 6 == 0, "").alias("death_date"), place.alias("birth_location"), location_key(place).alias("birth_location_key"),
            F.when(k % 4 == 0, F.concat_ws(", ", "n_name", "r_name")).alias("death_location"),
            F.lit(False).alias("is_living"), (k % 9).cast("int").alias("generation"),
            F.when(inside, _pid((2 * jp).cast("long"))).alias("father_wiki_id"),
            F.when(inside & far, _pid((2 * (jp + 1)).cast("long"))).when(inside, _pid((2 * jp + 1).cast("long"))).alias("mother_wiki_id"),
        )
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    raw = F.concat_ws(", ", "n_name", "r_name")
    at = F.when(n == 4, 3).otherwise(n)  # two nations share their coordinates
    return nation.select(
        (n + 1).cast("int").alias("id"), raw.alias("raw_location"), location_key(raw).alias("location_key"),
        F.when(~n.isin(7, 19), at * 2.5 - 20).cast("float").alias("latitude"), F.when(~n.isin(7, 19), at * 5 - 60).cast("float").alias("longitude"),
        F.when(n % 3 == 0, F.col("n_name")).alias("normalized_name"), F.lit("X").alias("country"), F.col("r_name").alias("state"), F.when(n % 3 == 1, "").when(n % 3 == 2, F.lower("n_name")).alias("city"),
    )


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey")
    pairs = c.where(k % 2 == 0).join(c.select((k - 1).alias("c_custkey")), "c_custkey", "left_semi")
    both = pairs.select(F.explode(F.array(F.struct(k.alias("a"), (k + 1).alias("b")), F.struct((k + 1).alias("a"), k.alias("b")))).alias("p"))
    out = both.select((F.col("p.a") + 1).cast("int").alias("person_id"), (F.col("p.b") + 1).cast("int").alias("related_person_id"), F.lit("spouse").alias("relationship_type"))
    return out.unionByName(c.where(k == 0).select(F.lit(1).alias("person_id"), F.lit(7).alias("related_person_id"), F.lit("parent").alias("relationship_type")))


def crawl_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = lambda c: F.max_by(c, F.struct("ts", "event_id"))
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(last("event_type").alias("kind"), last("value").alias("value"), F.min("ts").alias("created_at"), F.count_if(F.col("event_type") == "error").cast("int").alias("retry_count"))
    status = F.when(F.col("kind") == "purchase", "completed").when(F.col("kind") == "error", "error").when(F.col("kind") == "click", "processing").otherwise("pending")
    return e.select((F.col("user_id") + 1).cast("int").alias("id"), _pid(F.col("user_id")).alias("wiki_id"), status.alias("status"), F.floor(F.col("value") / 20).cast("int").alias("priority"), "created_at", "retry_count")


_KEY = r"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '\s*,\s*', ', ', 'g'), '^\s+|\s+$', '', 'g'), '[.,;]+$', ''), '')"


def key_sql(c: str) -> str:
    return _KEY.format(c)


#: The same tables for DuckDB, as common table expressions; put before SELECT by with_fixtures().
SQL = {
    "births": "SELECT o_custkey, CAST(min(year(o_orderdate)) AS VARCHAR) AS y FROM orders GROUP BY o_custkey",
    "base": """SELECT c_custkey AS k, c_custkey // 2 AS j, CAST(floor((c_custkey // 2 - 1) / 3.0) AS BIGINT) AS jp, c_name, c_mktsegment, y, n_name, r_name,
        CASE c_custkey % 3 WHEN 0 THEN concat_ws(', ', n_name, r_name) WHEN 1 THEN concat_ws(' ,  ', upper(n_name), r_name) ELSE '  ' || lower(concat_ws(',', n_name, r_name)) || '.' END AS place
        FROM customer LEFT JOIN births ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey""",
    "persons": f"""SELECT CAST(k + 1 AS INTEGER) AS id, 'P-' || k AS wiki_id, CAST(k + 1000 AS INTEGER) AS wiki_numeric_id, c_name AS name,
        upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS first_name, CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'Q' END AS middle_name,
        CASE WHEN k % 7 <> 0 THEN 'Line' || (k % 40) END AS last_name_birth, 'House' || (k % 11) AS last_name_current, CASE WHEN k % 23 = 0 THEN 'Jr' END AS suffix,
        CASE WHEN k % 17 = 0 THEN NULL WHEN k % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
        CASE k % 3 WHEN 0 THEN y WHEN 1 THEN 'about ' || y ELSE y || '-05-28' END AS birth_date, CASE WHEN k % 6 = 0 THEN '' END AS death_date,
        place AS birth_location, {key_sql("place")} AS birth_location_key, CASE WHEN k % 4 = 0 THEN concat_ws(', ', n_name, r_name) END AS death_location,
        FALSE AS is_living, CAST(k % 9 AS INTEGER) AS generation,
        CASE WHEN k % 2 = 0 AND k > 0 THEN 'P-' || (2 * jp) END AS father_wiki_id,
        CASE WHEN k % 2 = 0 AND k > 0 AND j % 10 = 0 AND jp + 1 < j THEN 'P-' || (2 * (jp + 1)) WHEN k % 2 = 0 AND k > 0 THEN 'P-' || (2 * jp + 1) END AS mother_wiki_id FROM base""",
    "locations": f"""SELECT CAST(n_nationkey + 1 AS INTEGER) AS id, concat_ws(', ', n_name, r_name) AS raw_location, {key_sql("concat_ws(', ', n_name, r_name)")} AS location_key,
        CASE WHEN n_nationkey NOT IN (7, 19) THEN CAST((CASE WHEN n_nationkey = 4 THEN 3 ELSE n_nationkey END) * 2.5 - 20 AS FLOAT) END AS latitude,
        CASE WHEN n_nationkey NOT IN (7, 19) THEN CAST((CASE WHEN n_nationkey = 4 THEN 3 ELSE n_nationkey END) * 5 - 60 AS FLOAT) END AS longitude,
        CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS normalized_name, 'X' AS country, r_name AS state, CASE n_nationkey % 3 WHEN 1 THEN '' WHEN 2 THEN lower(n_name) END AS city
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "relationships": """SELECT CAST(a.c_custkey + 1 AS INTEGER) AS person_id, CAST(b.c_custkey + 1 AS INTEGER) AS related_person_id, 'spouse' AS relationship_type
        FROM customer a JOIN customer b ON a.c_custkey // 2 = b.c_custkey // 2 AND a.c_custkey <> b.c_custkey UNION ALL SELECT 1, 7, 'parent'""",
    "crawl_queue": """SELECT CAST(user_id + 1 AS INTEGER) AS id, 'P-' || user_id AS wiki_id,
        CASE kind WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' WHEN 'click' THEN 'processing' ELSE 'pending' END AS status,
        CAST(floor(value / 20) AS INTEGER) AS priority, created_at, retry_count FROM (
        SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind, arg_max(value, (ts, event_id)) AS value, min(ts) AS created_at, CAST(count(*) FILTER (event_type = 'error') AS INTEGER) AS retry_count FROM events GROUP BY user_id)""",
    # parent rows of the graph, and the frontier of a breadth-first walk
    "edges": "SELECT wiki_id AS child, father_wiki_id AS parent, 0 AS role FROM persons WHERE father_wiki_id IS NOT NULL UNION ALL SELECT wiki_id, mother_wiki_id, 1 FROM persons WHERE mother_wiki_id IS NOT NULL",
}
_NEEDS = {"births": [], "base": ["births"], "persons": ["base"], "locations": [], "relationships": [], "crawl_queue": [], "edges": ["persons"]}


def with_fixtures(names: str, query: str, recursive: bool = False, more: str = "") -> str:
    """query with the named tables (space-separated) before it; more: further common table expressions."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS[n]:
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    ctes = [f"{n} AS ({SQL[n]})" for n in order] + ([more] if more else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {query}"

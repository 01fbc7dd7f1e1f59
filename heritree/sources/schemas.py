"""Schemas of the family-history tables and their constraints as data-quality checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ = T.StructField
PERSONS = T.StructType(
    [_("id", T.IntegerType(), False), _("wiki_id", T.StringType(), False), _("wiki_numeric_id", T.IntegerType())]
    + [_(c, T.StringType()) for c in ("name", "first_name", "middle_name", "last_name_birth", "last_name_current", "suffix", "gender", "birth_date", "death_date", "birth_location", "birth_location_key", "death_location", "death_location_key")]
    + [_("is_living", T.BooleanType()), _("generation", T.IntegerType()), _("father_wiki_id", T.StringType()), _("mother_wiki_id", T.StringType()), _("created_at", T.TimestampNTZType()), _("updated_at", T.TimestampNTZType())]
)
RELATIONSHIPS = T.StructType([_("id", T.IntegerType(), False), _("person_id", T.IntegerType(), False), _("related_person_id", T.IntegerType(), False), _("relationship_type", T.StringType(), False), _("created_at", T.TimestampNTZType())])
CRAWL_QUEUE = T.StructType(
    [_("id", T.IntegerType(), False), _("wiki_id", T.StringType(), False), _("status", T.StringType(), False), _("priority", T.IntegerType()), _("source_person_id", T.IntegerType()), _("created_at", T.TimestampNTZType()), _("processed_at", T.TimestampNTZType()), _("error_message", T.StringType()), _("retry_count", T.IntegerType())]
)
LOCATIONS = T.StructType(
    [_("id", T.IntegerType(), False), _("raw_location", T.StringType(), False), _("location_key", T.StringType()), _("latitude", T.FloatType()), _("longitude", T.FloatType())]
    + [_(c, T.StringType()) for c in ("normalized_name", "country", "state", "city")] + [_("geocoded_at", T.TimestampNTZType())]
)
METADATA = T.StructType([_("key", T.StringType(), False), _("value", T.StringType()), _("updated_at", T.TimestampNTZType())])


@dataclass(frozen=True)
class Constraints:
    unique: tuple[tuple[str, ...], ...] = ()
    values: dict[str, tuple[str, ...]] = field(default_factory=dict)


TABLES = {"persons": PERSONS, "relationships": RELATIONSHIPS, "crawl_queue": CRAWL_QUEUE, "locations": LOCATIONS, "crawl_metadata": METADATA}
CONSTRAINTS = {
    "persons": Constraints((("id",), ("wiki_id",))),
    "relationships": Constraints((("id",), ("person_id", "related_person_id", "relationship_type")), {"relationship_type": ("parent", "child", "spouse")}),
    "crawl_queue": Constraints((("id",), ("wiki_id",)), {"status": ("pending", "processing", "completed", "error")}),
    "locations": Constraints((("id",), ("raw_location",), ("location_key",))),
    "crawl_metadata": Constraints((("key",),)),
}


def jdbc_tables(spark: SparkSession, url: str, properties: dict[str, str] | None = None, partitions: int = 1) -> dict[str, DataFrame]:
    """The tables of a database by JDBC, with the columns of their schemas; more than one partition: read in ranges of id."""
    out = {}
    for name, schema in TABLES.items():
        df = spark.read.jdbc(url, name, properties=properties or {})
        if partitions > 1 and "id" in schema.names:
            low, high = df.selectExpr("min(id)", "max(id)").first()
            if low is not None:
                df = spark.read.jdbc(url, name, column="id", lowerBound=low, upperBound=high + 1, numPartitions=partitions, properties=properties or {})
        out[name] = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema])
    return out


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Temporary views of all tables, with their columns in order and cast; those that aren't given are empty."""
    for name, schema in TABLES.items():
        df = tables.get(name)
        df = spark.createDataFrame([], schema) if df is None else df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        df.createOrReplaceTempView(name)


def violations(df: DataFrame, table: str) -> DataFrame:
    """constraint, rows: how many rows break each NOT NULL, UNIQUE (nulls are no duplicates) or value rule; none: no row."""
    schema, rules = TABLES[table], CONSTRAINTS[table]
    single = [F.count_if(F.col(f.name).isNull()).alias(f"not null {f.name}") for f in schema if not f.nullable and f.name in df.columns]
    single += [F.count_if(~F.col(c).isin(*v)).alias(f"values {c}") for c, v in rules.values.items()]
    flat = df.agg(*single).unpivot([], [c for c in df.agg(*single).columns], "constraint", "rows") if single else None
    out = [flat] if flat is not None else []
    for keys in rules.unique:
        more = df.dropna(subset=list(keys)).groupBy(*keys).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("rows"))
        out.append(more.select(F.lit("unique " + ",".join(keys)).alias("constraint"), "rows"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.where("rows > 0")


def delete_persons(persons: DataFrame, relationships: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Persons without those whose id is in `gone`, and relationships without the rows that point to them (cascade)."""
    ids = gone.select(F.col("id").alias("__gone"))
    kept = persons.join(ids, persons["id"] == F.col("__gone"), "left_anti")
    edges = relationships.join(ids, F.col("person_id") == F.col("__gone"), "left_anti").join(ids, F.col("related_person_id") == F.col("__gone"), "left_anti")
    return kept, edges

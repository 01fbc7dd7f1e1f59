"""Birth places on a map: joins with locations, clusters, year filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cluster_id, cluster_label, gender_code, map_name, parse_year

NO_YEARS, UNKNOWN = (1700, 1900), (9999, 0)


def located(persons: DataFrame, locations: DataFrame, raw: bool = False) -> DataFrame:
    """Persons with the coordinates of their birth place, joined by normalised key (or by the raw text).

    Locations are far fewer than persons; Spark broadcasts them where their measured size allows, and else shuffles.
    """
    on = persons["birth_location"] == locations["raw_location"] if raw else persons["birth_location_key"] == locations["location_key"]
    there = locations["latitude"].isNotNull() & locations["longitude"].isNotNull()
    return persons.join(locations.where(there), on).select(
        persons["id"].alias("person_id"), "wiki_id", "name", "first_name", F.col("last_name_current").alias("last_name"), parse_year(F.col("birth_date")).alias("birth_year"), "gender",
        "latitude", "longitude", F.col("normalized_name").alias("location_name"), "state", "city",
    )


def in_years(rows: DataFrame, min_year: int | None = None, max_year: int | None = None) -> DataFrame:
    """Unknown years stay."""
    y = F.col("birth_year")
    if min_year is not None:
        rows = rows.where(y.isNull() | (y >= min_year))
    if max_year is not None:
        rows = rows.where(y.isNull() | (y <= max_year))
    return rows


def clusters(rows: DataFrame, with_persons: bool = True, label: str | None = None, coded: bool = False) -> DataFrame:
    """A row for each pair of coordinates: count, first and last year (9999 and 0 if none is known), names of the first person's place.

    Persons are a list of structs, as the map asks for; without them the aggregate is of constant size for each group, and
    `cluster_persons` gives them as rows. coded: genders as M, F and U.
    """
    of_first = lambda c: F.min_by(c, "person_id")
    labels = F.col(label) if label else cluster_label(F.col("location_name"), F.col("city"), F.col("state"))
    person = _person(coded)
    more = [F.array_sort(F.collect_list(person)).alias("persons")] if with_persons else []
    return (
        rows.groupBy("latitude", "longitude")
        .agg(F.count("*").alias("person_count"), of_first(labels).alias("location_name"), of_first("state").alias("state"), of_first("city").alias("city"),
             F.coalesce(F.min("birth_year"), F.lit(UNKNOWN[0])).alias("min_year"), F.coalesce(F.max("birth_year"), F.lit(UNKNOWN[1])).alias("max_year"), *more)
        .withColumn("id", cluster_id(F.col("latitude"), F.col("longitude")))
    )


def _person(coded: bool) -> Column:
    gender = gender_code(F.col("gender")) if coded else F.col("gender")
    return F.struct(F.col("person_id"), F.col("wiki_id"), map_name(F.col("name"), F.col("first_name"), F.col("last_name")).alias("name"), "birth_year", gender.alias("gender"))


def cluster_persons(rows: DataFrame, coded: bool = False) -> DataFrame:
    """id of the cluster and the persons' columns, a row for each person, whatever a place's size."""
    return rows.select(cluster_id(F.col("latitude"), F.col("longitude")).alias("id"), _person(coded).alias("p")).select("id", "p.*")


def year_range(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.min("birth_year"), F.lit(NO_YEARS[0])).alias("min_year"), F.coalesce(F.max("birth_year"), F.lit(NO_YEARS[1])).alias("max_year"))


def map_data(persons: DataFrame, locations: DataFrame, min_year: int | None = None, max_year: int | None = None, raw: bool = False) -> DataFrame:
    return clusters(in_years(located(persons, locations, raw), min_year, max_year))


def visible(points: DataFrame, year: int) -> DataFrame:
    return points.where(F.col("min_year") <= year)


def frames(points: DataFrame, start: int, last: int, step: int = 5) -> DataFrame:
    """year, n_clusters, n_persons of every frame of the time slider: running sums over the clusters' first years, not a join with each."""
    from pyspark.sql import Window

    first = F.greatest(F.lit(start), F.lit(start) + F.ceil((F.col("min_year") - start) / step) * step)  # the first frame that shows it
    shown = points.where(F.col("min_year") <= last).groupBy(first.cast("int").alias("year")).agg(F.count("*").alias("c"), F.sum("person_count").alias("p"))
    spark = points.sparkSession
    every = spark.range(start, last + 1, step).select(F.col("id").cast("int").alias("year"))
    w = Window.partitionBy(F.lit(0)).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)  # a row for each frame
    run = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long")
    return every.join(shown, "year", "left").select("year", run("c").alias("n_clusters"), run("p").alias("n_persons"))


def geocoding_status(persons: DataFrame, locations: DataFrame) -> DataFrame:
    """One row: distinct birth keys, locations, persons on the map, percent (may exceed 100; 0 without keys)."""
    keys = persons.agg(F.countDistinct("birth_location_key").alias("total_locations"))
    placed = persons.join(locations.where("latitude is not null"), F.col("birth_location_key") == F.col("location_key")).agg(F.count("*").alias("persons_with_coordinates"))
    done = locations.agg(F.count("*").alias("geocoded_locations"))
    percent = F.when(F.col("total_locations") > 0, F.col("geocoded_locations") / F.col("total_locations") * 100).otherwise(F.lit(0.0))
    return keys.crossJoin(F.broadcast(done)).crossJoin(F.broadcast(placed)).withColumn("percent_complete", percent)  # one row each

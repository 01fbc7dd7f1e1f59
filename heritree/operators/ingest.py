"""Ingest: profiles from polymorphic JSON, upserts and insert-ignore without MERGE, location keys.

Parquet has no row-level updates, so an upsert is target and source together with one row for each key; the caller
writes the result to a new version and swaps (see sources.snapshots).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import extract_ids, parent_id
from ..functions.text import SPACE, full_name, location_key
from ..storage import stored_rows
from .queue import first_wins

#: Columns that an upsert never sets.
CARRIED = ("id", "created_at", "generation")
#: Profile field to column.
FIELDS = {
    "FirstName": "first_name", "MiddleName": "middle_name", "LastNameAtBirth": "last_name_birth", "LastNameCurrent": "last_name_current", "Suffix": "suffix", "Gender": "gender",
    "BirthDate": "birth_date", "DeathDate": "death_date", "BirthLocation": "birth_location", "DeathLocation": "death_location",
}


def _is_one(v: Column) -> Column:
    """Whether a variant is the number 1, not a text or a truth value."""
    kind = F.schema_of_variant(v)
    return F.coalesce(~kind.isin("STRING", "BOOLEAN", "VOID") & (F.try_variant_get(v, "$", "double") == 1), F.lit(False))


def profiles(raw: DataFrame, json: str = "json") -> DataFrame:
    """raw with `profile` columns of its JSON documents; documents without a Name, or with an empty one, are dropped.

    Fields may be missing, null or of several types.
    """
    v = F.try_parse_json(json)
    text = lambda f: F.try_variant_get(v, f"$.{f}", "string")
    cols: dict[str, Column] = {c: text(f) for f, c in FIELDS.items()}
    named = {"first": cols["first_name"], "middle": cols["middle_name"], "birth_last": cols["last_name_birth"], "current_last": cols["last_name_current"], "suffix": cols["suffix"]}
    as_json = lambda f: F.to_json(F.try_variant_get(v, f"$.{f}", "variant"))
    return raw.select(
        *raw.columns, text("Name").alias("wiki_id"), F.try_variant_get(v, "$.Id", "int").alias("wiki_numeric_id"), full_name(**named, name=text("Name")).alias("name"),
        *[c.alias(n) for n, c in cols.items()], location_key(cols["birth_location"]).alias("birth_location_key"), location_key(cols["death_location"]).alias("death_location_key"),
        _is_one(F.try_variant_get(v, "$.IsLiving", "variant")).alias("is_living"), parent_id(F.col(json), "$.Father").alias("father_wiki_id"), parent_id(F.col(json), "$.Mother").alias("mother_wiki_id"),
        extract_ids(as_json("Spouses")).alias("spouse_ids"), extract_ids(as_json("Children")).alias("child_ids"),
    ).where("wiki_id <> ''")


def legacy_persons(imported: DataFrame) -> DataFrame:
    """Person columns from a progress document's persons (wiki_id, json), with their generation.

    Parents are taken by truth: null, "", 0 and false are none, but the texts "0" and "false" are kept. Other empty texts stay.
    """
    v = F.try_parse_json("json")
    get = lambda f, kind="string": F.try_variant_get(v, f"$.{f}", kind)
    parent = lambda f: F.when(~((get(f) == "") | (get(f).isin("0", "false") & (F.schema_of_variant(get(f, "variant")) != "STRING"))), get(f))
    same = ("name", *FIELDS.values())
    return imported.select(
        "wiki_id", get("id", "int").alias("wiki_numeric_id"), *[get(c).alias(c) for c in same],
        location_key(get("birth_location")).alias("birth_location_key"), location_key(get("death_location")).alias("death_location_key"),
        _is_one(get("is_living", "variant")).alias("is_living"), get("generation", "int").alias("generation"), parent("father_id").alias("father_wiki_id"), parent("mother_id").alias("mother_wiki_id"),
    )


def upsert(target: DataFrame, source: DataFrame, key: str = "wiki_id", seq: str = "seq", carried: tuple[str, ...] = CARRIED, merge: str = "overwrite", now: Column | None = None) -> DataFrame:
    """target after upserts of source in order of seq: the last row of a key wins, and `carried` columns keep the target's values.

    merge: "overwrite" takes the last row as it is, nulls too; "coalesce" takes the last non-null value of each column.
    Columns that the source lacks keep the target's values, but for updated_at, which is `now` (the current time) in all rows
    that are set, and created_at, which is so in new ones. `numbered` gives new rows their ids.
    """
    now = F.current_timestamp() if now is None else now
    given = [c for c in target.columns if c in source.columns and c not in (key, *carried, "updated_at")]
    last = (lambda c: F.max_by(c, seq)) if merge == "overwrite" else (lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))))
    new = source.groupBy(key).agg(*[last(c).alias(f"__{c}") for c in given], F.lit(True).alias("__set"))
    joined = target.withColumn("__there", F.lit(True)).join(new, key, "full")
    stamps = {"updated_at": F.when(F.col("__set"), now).otherwise(F.col("updated_at")) if "updated_at" in target.columns else None, "created_at": F.when(F.col("__there").isNull(), now).otherwise(F.col("created_at")) if "created_at" in target.columns else None}
    pick = lambda c: F.when(F.col("__set").isNull(), F.col(c)).otherwise(F.col(f"__{c}") if merge == "overwrite" else F.coalesce(f"__{c}", c))
    return joined.select(*[pick(c).alias(c) if c in given else stamps[c].alias(c) if c in stamps else F.col(c) for c in target.columns])


def numbered(rows: DataFrame, column: str, last: int, order: list[str]) -> DataFrame:
    """rows with numbers after `last`, without gaps, in the order of `order` where `column` is null; `order`'s helpers that begin with two underscores go.

    The numbers are a part's start and the place in it, so no task sees more than its range of the new rows.
    """
    kept = [c for c in rows.columns if not c.startswith("__")]
    old, new = rows.where(F.col(column).isNotNull()).select(*kept), rows.where(F.col(column).isNull())
    placed, n = stored_rows(new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    if not n:
        return old
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))  # a row a task
    at = F.lit(last + 1) + F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)
    done = placed.join(F.broadcast(starts), part == F.col("__part")).withColumn(column, at.cast(rows.schema[column].dataType))
    return old.unionByName(done.select(*kept))


def insert_ignore_locations(locations: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of batch (raw_location, location_key, seq, ...) that the table takes: neither the raw text nor a non-null key may be there already.

    Rows that the table has the text or the key of go first, whatever else the batch has; of the others, in order of seq,
    the first of each raw text stays, then the first of each key. That equals inserting one by one as long as equal raw
    texts of a batch have equal keys, which holds as the key is a function of the text.
    """
    return not_there(locations, locations, batch)


def not_there(raws: DataFrame, keys: DataFrame, batch: DataFrame) -> DataFrame:
    """The same with the texts and keys that are there as two tables, raw_location and location_key."""
    new = batch.join(raws.select("raw_location"), "raw_location", "left_anti").join(keys.select("location_key"), "location_key", "left_anti")
    new = first_wins(new.select(*batch.columns), ["raw_location"])
    keyed, bare = new.where("location_key is not null"), new.where("location_key is null")
    return first_wins(keyed, ["location_key"]).select(*batch.columns).unionByName(bare.select(*batch.columns))


def distinct_locations(persons: DataFrame) -> DataFrame:
    return persons.where("birth_location is not null and birth_location <> ''").select(F.col("birth_location").alias("raw_location")).distinct()


def to_geocode(persons: DataFrame, locations: DataFrame) -> DataFrame:
    """raw_location, location_key still to look up: neither spelling nor key is known, and one spelling stands for a key."""
    new = distinct_locations(persons).withColumn("location_key", location_key(F.col("raw_location")))
    new = new.join(locations.select("raw_location"), "raw_location", "left_anti").join(locations.select("location_key"), "location_key", "left_anti")
    return new.groupBy("location_key").agg(F.min("raw_location").alias("raw_location")).select("raw_location", "location_key")


def geocode(todo: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """The lookup as a join with a table of answers (raw_location, latitude, longitude, place_name, context array<struct<id,text>>)."""
    part = lambda *kinds: F.element_at(F.filter("context", lambda x: F.lit(False) | _starts(x["id"], kinds)), -1)["text"]
    return todo.join(gazetteer, "raw_location").select(
        "raw_location", "location_key", "latitude", "longitude", F.col("place_name").alias("normalized_name"), part("country").alias("country"), part("region").alias("state"), part("place").alias("city")
    )


def geocode_if_needed(locations: DataFrame, raw: DataFrame, gazetteer: DataFrame | None) -> DataFrame:
    """New rows for locations from raw (raw_location): not blank, its spelling not there yet, and found. Without a gazetteer (unavailable) there are none."""
    raw = raw.where(F.length(F.regexp_replace("raw_location", SPACE, "")) > 0).select("raw_location").distinct()
    todo = raw.join(locations.select("raw_location"), "raw_location", "left_anti").withColumn("location_key", location_key(F.col("raw_location")))
    if gazetteer is None:
        columns = ["raw_location", "location_key", *[F.lit(None).cast(k).alias(c) for c, k in (("latitude", "float"), ("longitude", "float"), ("normalized_name", "string"), ("country", "string"), ("state", "string"), ("city", "string"))]]
        return todo.where("false").select(*columns)
    found = geocode(todo, gazetteer).withColumn("seq", F.col("raw_location"))
    return insert_ignore_locations(locations, found).drop("seq")


def _starts(c: Column, kinds: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for k in kinds:
        out = out | c.startswith(k)
    return out


def backfill_keys(persons: DataFrame) -> DataFrame:
    return persons.withColumns({"birth_location_key": location_key(F.col("birth_location")), "death_location_key": location_key(F.col("death_location"))})


def backfill_location_keys(locations: DataFrame) -> DataFrame:
    """Keys of all locations; of those with the same key the first id keeps it, the others get null."""
    keyed = locations.withColumn("location_key", location_key(F.col("raw_location")))
    first = keyed.groupBy(F.col("location_key").alias("__key")).agg(F.min("id").alias("__first"))
    joined = keyed.join(first, F.col("location_key").eqNullSafe(F.col("__key")))
    return joined.withColumn("location_key", F.when(F.col("id") == F.col("__first"), F.col("location_key"))).select(*locations.columns)

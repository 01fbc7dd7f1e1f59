"""Profile documents from files: a Python data source that reads response files, and decoding against a schema.

A response is an array: [{"profile": ...}], [{"ancestors": [...]}], [{"descendants": [...]}], or [{}] for not found.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("profile", "ancestors", "descendants")
#: The fields that each kind of request asks for.
PROJECTIONS = {
    "profile": ["Id", "Name", "FirstName", "MiddleName", "LastNameAtBirth", "LastNameCurrent", "Suffix", "BirthDate", "DeathDate", "BirthLocation", "DeathLocation", "Gender", "Father", "Mother", "Spouses", "Children", "Parents", "BirthDateDecade", "DeathDateDecade", "IsLiving"],
    "ancestors": ["Id", "Name", "FirstName", "LastNameAtBirth", "BirthDate", "DeathDate", "BirthLocation", "Gender", "Father", "Mother"],
    "descendants": ["Id", "Name", "FirstName", "LastNameAtBirth", "BirthDate", "DeathDate", "BirthLocation", "Gender", "Father", "Mother", "Children"],
}


def responses(spark: SparkSession, path: str) -> DataFrame:
    """path, json: one row for each response file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))


def unpack(raw: DataFrame, kind: str) -> DataFrame:
    """json of each profile in the responses, cut to the fields of its kind; a response without one (not found) gives no row."""
    if kind not in KINDS:
        raise ValueError(kind)
    v = F.try_parse_json("json")
    one = F.try_variant_get(v, f"$[0].{kind}", "variant" if kind == "profile" else "array<variant>")
    items = F.array(one) if kind == "profile" else F.coalesce(one, F.array().cast("array<variant>"))
    keep = [c for c in raw.columns if c != "json"]
    return raw.select(*keep, F.posexplode(items).alias("nth", "v")).where("v is not null").select(*keep, "nth", F.to_json("v").alias("json"))


def projected(docs: DataFrame, kind: str) -> DataFrame:
    """The documents' fields of the kind's list as a map from field to JSON text; others are dropped."""
    wanted = F.array(*map(F.lit, PROJECTIONS[kind]))
    fields = F.from_json("json", "map<string,string>")
    return docs.withColumn("fields", F.map_filter(fields, lambda k, _: F.array_contains(wanted, k)))


def decode(docs: DataFrame, schema: str, strict: bool = False) -> DataFrame:
    """Schema on read; strict fails on a document that doesn't match, else it gets nulls and its text in `_corrupt`."""
    mode = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    full = schema if strict else f"{schema}, _corrupt string"
    return docs.withColumn("doc", F.from_json("json", full, mode))


def legacy_import(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """visited (wiki_id), queue (wiki_id, seq), persons (wiki_id, json) of one progress document."""
    doc = spark.read.schema("visited array<string>, queue array<string>, persons map<string,string>").json(path, multiLine=True)
    return (
        doc.select(F.explode("visited").alias("wiki_id")).distinct(),
        doc.select(F.posexplode("queue").alias("seq", "wiki_id")).select("wiki_id", "seq"),
        doc.select(F.explode("persons").alias("wiki_id", "json")),
    )


class TooManyRequests(Exception):
    def __init__(self, retry_after: float | None = None) -> None:
        super().__init__("too many requests")
        self.retry_after = 60.0 if retry_after is None else retry_after


@dataclass
class Policy:
    """Least time between requests, waits as told when refused, exponential retries of network errors, a longer pause after an error."""

    delay: float = 1.0
    max_retries: int = 3
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    last: float = field(default=-1e9)

    def call(self, fetch: Callable[[], str]) -> str:
        tries = 0
        while True:
            if (wait := self.last + self.delay - self.clock()) > 0:
                self.sleep(wait)
            self.last = self.clock()
            try:
                return fetch()
            except TooManyRequests as e:
                self.sleep(e.retry_after)
            except OSError:
                tries += 1
                if tries > self.max_retries:
                    self.sleep(2 * self.delay)
                    raise
                self.sleep(2 ** (tries - 1) + random.random() * 0.1)


def fetch_all(ids: list[str], get: Callable[[str], str], policy: Policy) -> Iterator[tuple[str, str | None, str | None]]:
    """(id, json, error): a failed id is reported and doesn't stop the others."""
    for i in ids:
        try:
            text = policy.call(lambda i=i: get(i))
            json.loads(text)
            yield i, text, None
        except Exception as e:  # noqa: BLE001
            yield i, None, str(e)

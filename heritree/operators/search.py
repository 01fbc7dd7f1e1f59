"""Search, paging, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_pattern, parse_year
from .graph import BadRequest

NAME_COLUMNS = ["name", "first_name", "middle_name", "last_name_birth", "last_name_current"]
LOCATION_COLUMNS = ["birth_location", "death_location"]
MAX_LIMIT = 100


def _any_contains(columns: list[str], term: str) -> Column:
    return reduce(Column.__or__, [F.col(c).ilike(contains_pattern(term)) for c in columns])


def matching(persons: DataFrame, query: str | None = None, location: str | None = None, year_from: int | None = None, year_to: int | None = None, use_years: bool = False) -> DataFrame:
    """Persons that meet all conditions given; years are accepted and, unless use_years, ignored."""
    conditions = []
    if query:
        conditions.append(_any_contains(NAME_COLUMNS, query))
    if location:
        conditions.append(_any_contains(LOCATION_COLUMNS, location))
    if use_years:
        year = parse_year(F.col("birth_date"))
        conditions += [year >= year_from] * (year_from is not None) + [year <= year_to] * (year_to is not None)
    return persons.where(reduce(Column.__and__, conditions)) if conditions else persons


def search_persons(persons: DataFrame, query: str | None = None, location: str | None = None, year_from: int | None = None, year_to: int | None = None, limit: int = 50, offset: int = 0, use_years: bool = False) -> DataFrame:
    """The page by name (nulls last, wiki_id as a tiebreak) with the total on each row."""
    if not 1 <= limit <= MAX_LIMIT or offset < 0:
        raise BadRequest(f"limit must be 1 to {MAX_LIMIT}, offset 0 or more")
    found = matching(persons, query, location, year_from, year_to, use_years)
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(F.col("name").asc_nulls_last(), "wiki_id").offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def stats(persons: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row, one action."""
    return persons.agg(F.count("*").alias("persons")).crossJoin(F.broadcast(relationships.agg(F.count("*").alias("relationships"))))


def page_math(total: Column, page: Column, size: int = 20) -> dict[str, Column]:
    offset = (page - 1) * size
    return {"offset": offset, "pages": F.ceil(total / size), "shown_from": F.when(total > 0, offset + 1).otherwise(0), "shown_to": F.least(offset + size, total)}


def top(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)

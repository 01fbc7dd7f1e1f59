"""Search for parts of texts by an inverted index of trigrams over a kept, ordered table.

Each indexed row has a posting for every run of three characters of its lowered texts. Postings are kept in chunks of
4096 neighbouring rows, so that no list grows with the table, in a table bucketed by trigram; `grams` has each one's
number of rows. A pattern's literal runs give its trigrams; the rarest ones' postings are intersected chunk by chunk, and
what is left is verified by the pattern itself, so the rows are those of a full search. Wildcards cut runs; a pattern
without a run of three characters, or with an escape, is answered by the full search.

Matching rows keep the table's order, in which they are numbered: a page needs the rids of its matches and then its rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions.text import contains_pattern
from ..storage import read_note, stored_rows, write_note
from . import ordered_table
from .graph import BadRequest
from .ordered_table import OrderedTable
from .search import LOCATION_COLUMNS, MAX_LIMIT, NAME_COLUMNS

GROUPS = {"name": NAME_COLUMNS, "location": LOCATION_COLUMNS}
N, CHUNK_BITS = 3, 12
_RARE = 3  # trigrams of a pattern that are intersected at most: the others are left to the verification
_FEW = 5_000  # candidates that are read by their rids; more are joined with the rows
_RANGES = 64
_CHUNKS = 8  # of rows whose postings one task lists
_SHARE = 8  # a rarest trigram that one row in so many has leaves the search to a reading of all rows, which a join with candidates needs too


def grams_of(pattern: str) -> list[str]:
    """Trigrams that every text with this (lowered) pattern holds; none if the pattern has an escape or no run of three characters."""
    return [] if "\\" in pattern else sorted({run[k : k + N] for run in re.split("[%_]", pattern) for k in range(len(run) - N + 1)})


def _grams(c: Column) -> Column:
    """The trigrams of a text, lowered; null or short texts have none."""
    low = F.coalesce(F.lower(c), F.lit(""))
    many = F.transform(F.sequence(F.lit(1), F.char_length(low) - (N - 1)), lambda k: F.substring(low, k, F.lit(N)))
    return F.when(F.char_length(low) >= N, many).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class SubstringIndex:
    spark: SparkSession
    path: str
    table: OrderedTable
    buckets: int

    @property
    def name(self) -> str:
        return f"postings_{hashlib.md5(self.path.encode()).hexdigest()[:16]}"

    def postings(self) -> DataFrame:
        """gram (with its group), chunk, rids (of that chunk, as offsets)."""
        return self.spark.table(self.name)

    def grams(self) -> DataFrame:
        return self.spark.read.schema("gram string, n long").parquet(f"{self.path}/grams")


def chunk_lists(table: OrderedTable, groups: dict[str, list[str]] = GROUPS) -> DataFrame:
    """gram (with its group), chunk, rids: the postings, listed by tasks of a few chunks each, however large the table's parts are."""
    of = lambda group, columns: F.transform(F.array_distinct(F.flatten(F.array(*map(_grams, columns)))), lambda g: F.concat(F.lit(f"{group}:"), g))
    texts = list(dict.fromkeys(c for columns in groups.values() for c in columns))
    chunk, offset = F.shiftright("rid", CHUNK_BITS).alias("chunk"), F.col("rid").bitwiseAND((1 << CHUNK_BITS) - 1).cast("int").alias("offset")
    # rows travel, not postings, of which each has dozens; a chunk lies in one task, so its lists are made where it is
    dealt = table.rows().select(chunk, offset, *texts).repartition(max(1, -(-table.total // (_CHUNKS << CHUNK_BITS))), "chunk")
    each = dealt.select("chunk", "offset", F.explode(F.concat(*[of(group, columns) for group, columns in groups.items()])).alias("gram"))
    return each.groupBy("gram", "chunk").agg(F.collect_list("offset").alias("rids"))


def build(persons: DataFrame, path: str, keys: tuple[str, ...] = ("name", "wiki_id"), groups: dict[str, list[str]] = GROUPS, rows: int = ordered_table.ROWS, buckets: int | None = None) -> SubstringIndex:
    """Writes persons in the order of keys to path, with postings of each group's columns."""
    spark = persons.sparkSession
    table = ordered_table.build(persons, f"{path}/table", keys, rows)
    lists = chunk_lists(table, groups)
    index = SubstringIndex(spark, path, table, buckets or max(8, -(-table.total // 1_000_000)))
    # a trigram that most texts have is dealt by chunk
    bucket, deal = F.pmod(F.hash("gram"), F.lit(index.buckets)), F.pmod(F.shiftright("chunk", 8), F.lit(8))
    dealt = lists.repartition(index.buckets * (8 if table.total > 1 << 23 else 1), bucket, *([deal] if table.total > 1 << 23 else []))
    dealt.write.format("parquet").bucketBy(index.buckets, "gram").sortBy("gram", "chunk").option("path", f"{path}/postings").saveAsTable(index.name)
    index.postings().groupBy("gram").agg(F.sum(F.size("rids")).alias("n")).orderBy("gram").write.parquet(f"{path}/grams")
    write_note(spark, f"{path}/manifest", {"buckets": index.buckets})
    return index


def open_index(spark: SparkSession, path: str) -> SubstringIndex:
    """An index that was built before; FileNotFoundError without a whole one."""
    index = SubstringIndex(spark, path, ordered_table.open_table(spark, f"{path}/table"), read_note(spark, f"{path}/manifest")["buckets"])
    place = f"{path}/postings".replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {index.name} (gram string, chunk long, rids array<int>) USING parquet CLUSTERED BY (gram) SORTED BY (gram, chunk) INTO {index.buckets} BUCKETS LOCATION '{place}'")
    return index


def kept(spark: SparkSession, name: str, persons) -> SubstringIndex:
    """This application's index of that name; persons() is asked for the table the first time only."""
    found = storage.kept(spark, "substring-index", name, lambda path: build(persons(), path))
    return found if found.spark is spark else open_index(spark, found.path)


def _lower(spark: SparkSession, text: str) -> str:
    """As the index lowers texts."""
    return text.lower() if text.isascii() else spark.range(1).select(F.lower(F.lit(text))).first()[0]


def candidates(index: SubstringIndex, terms: dict[str, str]) -> tuple[DataFrame | None, int]:
    """rid of the rows that hold the rarest trigrams of all terms (group to term), and no more than how many; None if the terms have no trigram."""
    wanted = [f"{group}:{g}" for group, term in terms.items() for g in grams_of(_lower(index.spark, term))]
    if not wanted:
        return None, index.table.total
    known = {r["gram"]: r["n"] for r in index.grams().where(F.col("gram").isin(wanted)).collect()}  # a few for each character of the terms
    if len(known) < len(wanted):
        return index.table.rows().select("rid").where("false"), 0
    rare = sorted(known, key=lambda g: (known[g], g))[:_RARE]
    lists = index.postings().where(F.col("gram").isin(rare))
    if len(rare) == 1:
        both = lists.select("chunk", "rids")
    else:
        met = lists.groupBy("chunk").agg(*[F.first(F.when(F.col("gram") == g, F.col("rids")), ignorenulls=True).alias(f"g{k}") for k, g in enumerate(rare)])
        both = met.select("chunk", reduce(F.array_intersect, [F.col(f"g{k}") for k in range(len(rare))]).alias("rids"))
    start = F.call_function("shiftleft", F.col("chunk"), F.lit(CHUNK_BITS))
    return both.select(start.alias("start"), F.explode("rids").alias("at")).select((F.col("start") + F.col("at")).alias("rid")), known[rare[0]]


def _rows_of(index: SubstringIndex, rids: list[int]) -> DataFrame:
    """The rows of some rids, by their parts' files and pages."""
    parts = sorted({r >> ordered_table._PLACE_BITS for r in rids})
    files = [p["file"] for p in index.table.parts().where(F.col("part").isin(parts)).collect()]
    chunks = sorted({r >> CHUNK_BITS for r in rids})
    spans = [(c << CHUNK_BITS, ((c + 1) << CHUNK_BITS) - 1) for c in chunks] if len(chunks) <= _RANGES else [(min(rids), max(rids))]
    near = [F.col("rid").between(a, b) for a, b in spans]
    return index.table.rows(files).where(reduce(Column.__or__, near) if near else F.lit(False)).where(F.col("rid").isin(rids))


def found_rows(index: SubstringIndex, terms: dict[str, str], groups: dict[str, list[str]] = GROUPS) -> DataFrame:
    """All rows whose group's columns hold the terms, with their rid."""
    likes = [reduce(Column.__or__, [F.col(c).ilike(contains_pattern(term)) for c in groups[group]]) for group, term in terms.items()]
    rids, most = candidates(index, terms)
    if rids is None or most > max(_FEW, index.table.total // _SHARE):
        rows = index.table.rows()
    elif most <= _FEW:
        rows = _rows_of(index, [r["rid"] for r in rids.collect()])  # at most _FEW
    else:
        rows = index.table.rows().join(rids, "rid", "left_semi")
    return rows.where(reduce(Column.__and__, likes)) if likes else rows


def search_persons(index: SubstringIndex, query: str | None = None, location: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """The page by the table's order with the total on each row, as `search.search_persons` has it. Matches are found once; the page's rows are read by their rids."""
    if not 1 <= limit <= MAX_LIMIT or offset < 0:
        raise BadRequest(f"limit must be 1 to {MAX_LIMIT}, offset 0 or more")
    terms = {g: t for g, t in (("name", query), ("location", location)) if t}
    if not terms:
        return ordered_table.page(index.table, limit, offset)
    matches, total = stored_rows(found_rows(index, terms).select("rid"), "matches")
    rids = [r["rid"] for r in matches.orderBy("rid").offset(offset).limit(limit).collect()]  # one page
    return _rows_of(index, rids).orderBy("rid").drop("rid").withColumn("total", F.lit(total).cast("long"))

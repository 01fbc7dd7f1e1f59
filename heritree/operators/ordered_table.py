"""A table kept in its order, with the order's statistics: deep pages read one range, keyset tokens go on from a row.

The rows are cut by ranges of the order and sorted; each has a number, `rid`, that ascends with the order (its part's
number and its place in the part). `parts` has a row for each part: its file, first and last keys, its rows and how many
rows come before it. The page at an offset is a range of rids in one or two files; the page after a token starts in the
part where its keys belong. Nothing is sorted or counted by a query.

Ascending keys, nulls last; the last key should be unique, as rows of equal keys stand in no defined order.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import discard, read_note, stored_rows, write_note
from .graph import BadRequest

ROWS = 1_000_000  # rows in a part, about
_PAGE = 4096  # rows in a page of a file, which is the least that a range of rids reads
_PLACE_BITS = 33  # of a rid, that count rows in a part


def ascending(keys: tuple[str, ...]) -> list[Column]:
    return [F.col(k).asc_nulls_last() for k in keys]


@dataclass(frozen=True)
class OrderedTable:
    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    total: int

    def parts(self) -> DataFrame:
        """part, file, n, start (rows before it), first and last (its keys)."""
        keys = ", ".join(f"{k}: {t}" for k, t in self._key_types())
        return self.spark.read.schema(f"part long, file string, n long, start long, first struct<{keys}>, last struct<{keys}>").parquet(f"{self.path}/parts")

    def _key_types(self) -> list[tuple[str, str]]:
        kinds = dict(self.rows().dtypes)
        return [(k, kinds[k]) for k in self.keys]

    def rows(self, files: list[str] | None = None) -> DataFrame:
        """The rows with their rid, of all files or of some."""
        if files == []:
            return self.rows().where("false")
        return self.spark.read.schema(self.schema).parquet(*(files or [f"{self.path}/rows"]))


def build(df: DataFrame, path: str, keys: tuple[str, ...], rows: int = ROWS) -> OrderedTable:
    """Writes df in the order of its keys to path."""
    if "rid" in df.columns:
        raise ValueError("rid is the row's number")
    spark = df.sparkSession
    once, n = stored_rows(df, "to-order")  # ranges are sampled first
    ordered = once.repartitionByRange(max(1, -(-n // rows)), *ascending(keys)).sortWithinPartitions(*ascending(keys))
    out = ordered.withColumn("rid", F.monotonically_increasing_id())
    out.write.option("parquet.page.row.count.limit", _PAGE).parquet(f"{path}/rows")
    discard(once)
    schema = out._jdf.schema().toDDL()
    written = spark.read.schema(schema).parquet(f"{path}/rows")
    ends = F.struct(*[F.col(k) for k in keys])
    part = written.groupBy(F.shiftright("rid", _PLACE_BITS).alias("part")).agg(
        F.first(F.col("_metadata.file_path")).alias("file"), F.count("*").alias("n"), F.min_by(ends, "rid").alias("first"), F.max_by(ends, "rid").alias("last")
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    part = part.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    part.select("part", "file", "n", "start", "first", "last").coalesce(1).write.parquet(f"{path}/parts")
    write_note(spark, f"{path}/manifest", {"schema": schema, "keys": keys, "total": n})
    return OrderedTable(spark, path, schema, tuple(keys), n)


def open_table(spark: SparkSession, path: str) -> OrderedTable:
    """A table that was built before; FileNotFoundError without a whole one."""
    note = read_note(spark, f"{path}/manifest")
    return OrderedTable(spark, path, note["schema"], tuple(note["keys"]), note["total"])


def page(table: OrderedTable, limit: int, offset: int = 0) -> DataFrame:
    """The rows at offset .. offset + limit - 1 of the order, with the table's `total`."""
    if limit < 1 or offset < 0:
        raise BadRequest("limit must be 1 or more, offset 0 or more")
    hit = table.parts().where((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset)).collect()  # limit / rows of a part + 2
    ranges = [F.col("rid").between((p["part"] << _PLACE_BITS) + max(0, offset - p["start"]), (p["part"] << _PLACE_BITS) + min(p["n"], offset + limit - p["start"]) - 1) for p in hit]
    rows = table.rows([p["file"] for p in hit])
    return (rows.where(reduce(Column.__or__, ranges)) if ranges else rows).orderBy("rid").drop("rid").withColumn("total", F.lit(table.total).cast("long"))


def token(row, keys: tuple[str, ...]) -> str:
    """What stands for a row's place: opaque, and good for later versions of the table too."""
    return base64.urlsafe_b64encode(json.dumps([row[k] for k in keys]).encode()).decode()


def _after(columns: list[Column], values: list) -> Column:
    """Whether the keys come after the values, nulls last."""
    out = F.lit(False)
    for c, v in reversed(list(zip(columns, values))):
        if v is None:  # nothing comes after null, and nulls are equal
            out = c.isNull() & out
        else:
            out = c.isNull() | (c > F.lit(v)) | ((c == F.lit(v)) & out)
    return F.coalesce(out, F.lit(False))


def page_after(table: OrderedTable, limit: int, after: str | None = None) -> DataFrame:
    """The next `limit` rows after a token's row, or the first ones, with `total`; a token whose row isn't there any more goes on from its place."""
    if after is None:
        return page(table, limit)
    if limit < 1:
        raise BadRequest("limit must be 1 or more")
    try:
        values = json.loads(base64.urlsafe_b64decode(after))
    except ValueError as e:
        raise BadRequest("not a token") from e
    if not isinstance(values, list) or len(values) != len(table.keys):
        raise BadRequest("not a token")
    kinds = [k for _, k in table._key_types()]
    typed = [None if v is None else F.lit(v).cast(k) for v, k in zip(values, kinds)]
    later = table.parts().where(_after([F.col(f"last.{k}") for k in table.keys], typed)).orderBy("part")
    # the first of these may hold rows on both sides of the token, the next ones are whole
    files, whole = [], 0
    for p in later.limit(2 + limit // max(1, ROWS)).select("file", "n").collect() if table.total else []:
        files.append(p["file"])
        whole += p["n"] if len(files) > 1 else 0
        if whole >= limit:
            break
    else:
        if whole < limit and files:  # small parts: as many as it takes
            running = F.sum("n").over(Window.orderBy("part"))
            n0 = later.first()["n"]
            files = [r["file"] for r in later.withColumn("run", running).where(F.col("run") - F.col("n") < limit + n0).select("file").collect()]
    rows = table.rows(files).where(_after([F.col(k) for k in table.keys], typed))
    return rows.orderBy("rid").limit(limit).drop("rid").withColumn("total", F.lit(table.total).cast("long"))

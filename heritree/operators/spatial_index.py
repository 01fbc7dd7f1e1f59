"""A packed index of boxes: files in the order of a Hilbert curve, and a table of the files' boxes that prunes them.

Boxes are ordered by the place of their centre on a Hilbert curve over the whole extent, which keeps neighbours in both
directions together, and cut into files of about as many boxes each by ranges of that order; boxes of one place are cut
by a hash. `tiles` has a row for each file with the smallest box around its boxes. A window reads the files whose box it
touches, so what it reads grows with its area, however many boxes there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..storage import read_note, stored_rows, write_note

BOX = ("min_x", "min_y", "max_x", "max_y")
LEVELS = 20  # of the curve: 2**20 cells either way
ROWS = 200_000  # boxes in a file, about
_LISTED = 10_000  # files up to which a window names its files; a window of more reads the folder


def hilbert(x: Column, y: Column, levels: int = LEVELS) -> Column:
    """The place of cell (x, y), each in 0 .. 2**levels - 1, on the Hilbert curve. In Arrow batches: its levels are a loop, which expressions are slow at."""

    @F.pandas_udf("long")
    def place(xs: pd.Series, ys: pd.Series) -> pd.Series:
        x, y = xs.to_numpy(np.int64).copy(), ys.to_numpy(np.int64).copy()
        out = np.zeros(len(x), np.int64)
        for k in range(levels - 1, -1, -1):
            right, top = x >> k & 1, y >> k & 1
            out = out * 4 + (3 * right ^ top)
            # the lower quadrants are turned
            x, y = x & (1 << k) - 1, y & (1 << k) - 1
            mirrored = (top == 0) & (right == 1)
            x, y = np.where(mirrored, (1 << k) - 1 - x, x), np.where(mirrored, (1 << k) - 1 - y, y)
            x, y = np.where(top == 0, y, x), np.where(top == 0, x, y)
        return pd.Series(out)

    return place(x, y)


@dataclass(frozen=True)
class SpatialIndex:
    spark: SparkSession
    path: str
    schema: str

    def tiles(self) -> DataFrame:
        """file, n, min_x .. max_y: one row for each file."""
        return self.spark.read.schema(f"file string, n long, {', '.join(f'{c} double' for c in BOX)}").parquet(f"{self.path}/tiles")

    def boxes(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/boxes")


def build(boxed: DataFrame, path: str, rows: int = ROWS) -> SpatialIndex:
    """Writes boxes (min_x, min_y, max_x, max_y and other columns) to path. A box with a null or NaN side is nowhere and left out."""
    spark, columns = boxed.sparkSession, boxed.columns
    there = boxed.where(" and ".join(f"{c} is not null and not isnan({c})" for c in BOX))
    cx, cy = (F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2
    n, x0, x1, y0, y1 = there.agg(F.count("*"), F.min(cx), F.max(cx), F.min(cy), F.max(cy)).first()
    cell = lambda c, low, high: F.lit(0) if not n or high <= low else F.least(F.lit(2**LEVELS - 1), F.floor((c - low) / (high - low) * 2**LEVELS))
    place = hilbert(cell(cx, x0, x1), cell(cy, y0, y1))
    named = next(c for k in range(len(columns) + 1) if (c := f"__place{k}") not in columns)
    own = [F.col(f"`{c}`") for c in columns]
    # the ranges' sample takes places a second time: they cost less than a stored copy of all boxes, and ties are made where they are compared
    order = [F.col(named), F.xxhash64(*own)]
    placed = there.select(*own, place.alias(named))
    out = placed.repartitionByRange(max(1, -(-n // rows)), *order).sortWithinPartitions(*order).select(*own)
    out.write.parquet(f"{path}/boxes")
    index = SpatialIndex(spark, path, out._jdf.schema().toDDL())
    sides = [f(F.col(c).cast("double")).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), BOX)]
    index.boxes().groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), *sides).coalesce(1).write.parquet(f"{path}/tiles")
    write_note(spark, f"{path}/manifest", {"schema": index.schema})
    return index


def open_index(spark: SparkSession, path: str) -> SpatialIndex:
    """An index that was built before; FileNotFoundError without a whole one."""
    return SpatialIndex(spark, path, read_note(spark, f"{path}/manifest")["schema"])


def kept(spark: SparkSession, name: str, boxed, rows: int = ROWS) -> SpatialIndex:
    """This application's index of that name; boxed() is asked for the boxes the first time only."""
    return SpatialIndex(spark, (found := storage.kept(spark, "spatial-index", name, lambda path: build(boxed(), path, rows))).path, found.schema)


def _touches(x1: float, y1: float, x2: float, y2: float) -> Column:
    return (F.col("min_x") <= x2) & (F.col("max_x") >= x1) & (F.col("min_y") <= y2) & (F.col("max_y") >= y1)


def window(index: SpatialIndex, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """The boxes that touch the rectangle, edges included."""
    hit = _touches(x1, y1, x2, y2)
    files = [r["file"] for r in index.tiles().where(hit).select("file").limit(_LISTED + 1).collect()]
    if len(files) > _LISTED:
        return index.boxes().where(hit)
    found = index.spark.read.schema(index.schema).parquet(*files) if files else index.boxes().where("false")
    return found.where(hit)


def at_point(index: SpatialIndex, x: float, y: float, key: str) -> DataFrame:
    """The box at the point, the one of the least key of several; no row without one."""
    return window(index, x, y, x, y).orderBy(key).limit(1)


def windows(index: SpatialIndex, asked: DataFrame) -> DataFrame:
    """For many windows at once (x1, y1, x2, y2 and other columns, a small table): each with the boxes that it touches.

    Windows meet tiles first, which is a join of two small tables, and then the boxes of their tiles by file. Up to
    _LISTED such meetings go to the tasks that read the tiles' files; for more, boxes and meetings are shuffled by file.
    """
    w = asked.withColumn("__w", F.struct(*[F.col(f"`{c}`") for c in asked.columns])).select("__w")
    side = lambda c: F.col(f"__w.{c}")
    touch = (F.col("min_x") <= side("x2")) & (F.col("max_x") >= side("x1")) & (F.col("min_y") <= side("y2")) & (F.col("max_y") >= side("y1"))
    tiles, n = stored_rows(w.join(index.tiles(), touch).select("__w", F.col("file").alias("__tile")), "window-tiles")
    columns = index.boxes().columns
    boxes = index.boxes()
    if n <= _LISTED:  # only their files are read, and no box is moved
        files = [r["__tile"] for r in tiles.select("__tile").distinct().collect()]
        boxes = index.spark.read.schema(index.schema).parquet(*files) if files else boxes.where("false")
        tiles = F.broadcast(tiles)
    boxes = boxes.withColumn("__file", F.col("_metadata.file_path"))
    return boxes.join(tiles, (F.col("__file") == F.col("__tile")) & touch).select("__w.*", *[f"`{c}`" for c in columns])

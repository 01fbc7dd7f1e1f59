"""Vectors of floats as vectors of integers, which sums and distances are exact on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    ok = lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf")))  # noqa: E731  NaN counts as larger
    return F.coalesce(F.forall(vector, ok), F.lit(False))


def integers(vector: Column, limit: int, scale: int = SCALE) -> Column:
    """floor(scale * entry) of each entry, as long; entries beyond limit either way count as the limit."""
    low, high = F.lit(float(-limit)), F.lit(float(limit))
    return F.transform(vector, lambda c: F.floor(F.greatest(low, F.least(high, c.cast("double") * scale))).cast("long"))


def usual_length(df: DataFrame, vector: str) -> int | None:
    """The length that most finite vectors have (the greater of two that tie); None where there is none."""
    sizes = df.where(finite(F.col(vector))).groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return first[0]["d"] if first else None


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A batch of vectors of d longs as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)

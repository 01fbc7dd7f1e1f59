"""Embedding whitening by the exact characteristic polynomial of the integer scatter matrix.

Entries become integers, floor(256 c). The fit list is each distinct vector once: with n vectors, sums S and products Q,
M = n Q - S S' is n squared times the covariance, in integers. Tasks sum exact products of their vectors; tasks also
take M's characteristic polynomial modulo one prime each, by Hessenberg reduction; the driver gets d (d + 3) / 2 sums and
d + 1 residues a prime, puts the polynomial together by Chinese remaindering, isolates its largest roots and finds
their vectors by null-space inverse iteration, in 150 digits. So close eigenvalues are told apart as well as far ones.

Defined results: a vector that is null, or holds a null or a non-finite number, is dropped, and so is one of another
length than most have; each remaining row stays a row, whatever its id. Components without variance don't exist: a table
of one distinct vector, or an empty one, gives no rows; a table whose vectors span fewer dimensions gives fewer
components. Components of a multiple eigenvalue are any orthonormal ones. Entries beyond 2**31 / 256 either way count as
that; a deviation that doesn't fit in a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exact_roots
from .common import discard, ship, stored
from .vectors import finite, integers, matrix, usual_length

COMPONENTS, LIMIT = 4, 1 << 31
_EXACT = 1 << 53  # sums of products up to here are exact in doubles


@dataclass
class Whitening:
    """n distinct vectors with `sums`; components as rows of `vectors` (unit length), their eigenvalues and the covariance's trace; axes: vectors over the eigenvalues' roots."""

    n: int
    sums: list[int]
    values: list[float]
    explained: list[float]
    vectors: np.ndarray
    axes: np.ndarray

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """rows x components."""
        return (x.astype(object) * self.n - np.array(self.sums, dtype=object)).astype(np.float64) / self.n @ self.axes.T if self.large(x) else (x * self.n - np.array(self.sums, np.int64)) / self.n @ self.axes.T

    def large(self, x: np.ndarray) -> bool:
        """Whether n x - S could leave 62 bits."""
        return (int(np.abs(x).max(initial=0)) + 1) * self.n + max(map(abs, self.sums)) > 1 << 62

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S) squared; None where it isn't a long."""
        apart = x.astype(object) * self.n - np.array(self.sums, dtype=object) if self.large(x) else x * self.n - np.array(self.sums, np.int64)
        most = max(map(abs, apart.ravel().tolist()), default=0) if apart.dtype == object else int(np.abs(apart).max(initial=0))
        if most * most * x.shape[1] < 1 << 63:
            return (apart.astype(np.int64) ** 2).sum(axis=1).tolist()
        return [s if (s := sum(v * v for v in row)) < 1 << 63 else None for row in apart.tolist()]


def _vectors(df: DataFrame, vector: str, length: int, *more: Column) -> DataFrame:
    kept = df.where(finite(F.col(vector)) & (F.size(vector) == length))
    return kept.select(*more, integers(F.col(vector), LIMIT).alias("x"))


def moments(fit: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, S and Q (sums of products) of the vectors x, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), dtype=object)
        for b in batches:
            x = matrix(b.column("x"), d)
            x = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1)  # the last column counts and sums
            most = int(np.abs(x).max(initial=1))
            step = _EXACT // (most * most)  # rows whose products a double still sums exactly
            if step >= 64:
                for k in range(0, len(x), step):
                    part = x[k : k + step].astype(np.float64)
                    total += (part.T @ part).astype(np.int64).astype(object)
            else:
                part = x.astype(object)
                total += part.T @ part
        i, j = np.triu_indices(d + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array([str(v) for v in total[i, j]])], names=["i", "j", "v"])

    sums = fit.select("x").mapInArrow(run, "i long, j long, v string").groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out = [[0] * (d + 1) for _ in range(d + 1)]
    for r in sums.collect():  # d (d + 3) / 2 + 1 rows
        out[r["i"]][r["j"]] = out[r["j"]][r["i"]] = int(r["v"])
    return out[d][d], out[d][:d], [row[:d] for row in out[:d]]


def polynomial(spark, scatter: list[list[int]]) -> list[int]:
    """Coefficients of a positive semidefinite integer matrix's characteristic polynomial, lowest first; a task for each few primes."""
    d = len(scatter)
    primes = exact_roots.primes_for(exact_roots.coefficient_bound(sum(scatter[k][k] for k in range(d)), d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("id").to_pylist():
                p = primes[k]
                image = np.array([[v % p for v in row] for row in scatter], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([exact_roots.polynomial_mod(image, p)], pa.list_(pa.int64()))], names=["k", "r"])

    found = spark.range(0, len(primes), 1, min(len(primes), 32)).mapInArrow(run, "k long, r array<long>").collect()  # d + 1 numbers a prime
    residues = {r["k"]: r["r"] for r in found}
    return exact_roots.remaindered([residues[k] for k in range(len(primes))], primes)


def fitted(fit: DataFrame, d: int, k: int = COMPONENTS) -> Whitening | None:
    """Of distinct vectors x; None where they have no variance."""
    n, sums, products = moments(fit, d)
    scatter = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    trace = sum(scatter[i][i] for i in range(d))
    if not trace:
        return None
    roots = exact_roots.largest_roots(polynomial(fit.sparkSession, scatter), k, trace)
    values, vectors, explained = [], [], []
    with localcontext() as context:
        context.prec = exact_roots.DIGITS
        for root in roots:
            value = Decimal(root[0]) / Decimal(2) ** root[1]
            for v in exact_roots.null_vectors(scatter, root)[: k - len(values)]:
                values.append(float(value / n / n))
                explained.append(float(value / trace))
                vectors.append([float(c) for c in v])
    axes = np.array(vectors) / np.sqrt(np.array(values))[:, None]
    return Whitening(n, sums, values, explained, np.array(vectors), axes)


def fit(df: DataFrame, vector: str = "embedding", k: int = COMPONENTS) -> tuple[Whitening, float] | None:
    """The whitening of all distinct vectors of df, and the largest absolute entry of the whitened fit list's covariance minus the identity."""
    d = usual_length(df, vector)
    if not d:
        return None
    ship(df.sparkSession)
    distinct = stored(_vectors(df, vector, d).distinct(), "distinct-vectors")
    if (model := fitted(distinct, d, k)) is None:
        return None
    m = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = model.whitened(matrix(b.column("x"), d))
            yield pa.RecordBatch.from_arrays([pa.array(y[:, c]) for c in range(m)], names=[f"y{c}" for c in range(m)])

    pairs = [(a, b) for a in range(m) for b in range(a, m)]
    y = distinct.mapInArrow(run, ", ".join(f"y{c} double" for c in range(m)))
    found = y.agg(*[F.covar_pop(f"y{a}", f"y{b}") for a, b in pairs]).first()  # by deviations from running means
    discard(distinct)
    return model, max(abs(v - (a == b)) for v, (a, b) in zip(found, pairs))


def whitened(df: DataFrame, model: Whitening, vector: str = "embedding", out: str = "whitened") -> DataFrame:
    """The rows of df whose vectors count, with `out` (array<double>) and `out`_deviation (long)."""
    ship(df.sparkSession)
    d, row = len(model.sums), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    rows = _vectors(df, vector, d, row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"), d)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(list(model.whitened(x)), pa.list_(pa.float64())), pa.array(model.deviations(x), pa.int64())], names=["row", "y", "apart"])

    done = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, y array<double>, apart long")
    return done.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c not in (out, f"{out}_deviation")], F.col("y").alias(out), F.col("apart").alias(f"{out}_deviation"))


def whitening_report(df: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    found = fit(df)
    if found is None:
        kinds = (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))
        return df.select("vec_id", *[F.lit(None).cast(k).alias(c) for c, k in kinds]).where("false")
    model, error = found
    rows = whitened(df.select("vec_id", "embedding"), model).select("vec_id", "whitened_deviation", F.posexplode("whitened").alias("at", "value"))
    explained = F.get(F.array(*[F.lit(e) for e in model.explained]), F.col("at"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("whitened_deviation").alias("deviation"), F.col("value").alias("whitened"), explained.alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )

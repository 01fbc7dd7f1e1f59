"""Vector code compression: product codes whose nearest entries are found by slicing and intersecting bitmasks.

A vector's integers are cut into equal consecutive parts; each part position has a codebook of at most 64 entries. For
every dimension of a part the entries' coordinates are sorted, and each place in that order carries the mask (a uint64,
one bit an entry) of all entries before it. Entries within a radius of a coordinate are then two binary searches and the
difference of two masks; the AND over the dimensions leaves the entries in the box around the part, which holds all
entries within the radius. The best of these is the nearest entry if it lies within the radius itself; else its distance
is the next radius, and a box without entries is doubled. Candidates are taken by rising index, so ties go to the lower one.

Codebooks are small (parts x 64 x width) and travel with the tasks; a round sums each entry's parts per task and by key.

Defined results: a vector that is null, or holds a null or a non-finite number, is dropped, and so is one of another
length than most have. Null ids come last, equal ids in order of their vectors, and each row stays a row. Fewer than 64
rows make fewer entries. A length that the number of parts doesn't divide is filled up with zeros. Numbers so large that
a squared distance could leave 62 bits count as the largest that can't; a label's sum that isn't a long is null. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, stored
from .vectors import finite, integers, matrix, usual_length

PARTS, ENTRIES, ROUNDS = 16, 64, 2
_SALTS = 32  # tasks among which the rows of one label are dealt when they get its sum


class Slices:
    """The sorted coordinates of one codebook (entries x width) with their prefix masks."""

    def __init__(self, entries: np.ndarray) -> None:
        if len(entries) > 64:
            raise ValueError("a mask has 64 bits")
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = [entries[order[:, k], k] for k in range(entries.shape[1])]
        bits = np.uint64(1) << np.arange(len(entries), dtype=np.uint64)
        self.prefix = [np.concatenate([np.zeros(1, np.uint64), np.bitwise_or.accumulate(bits[order[:, k]])]) for k in range(entries.shape[1])]
        # to begin with: how far entries usually are from their nearest neighbour
        apart = ((entries[:, None] - entries[None]) ** 2).sum(axis=2)
        np.fill_diagonal(apart, np.iinfo(np.int64).max)
        self.radius = isqrt(int(np.median(apart.min(axis=1)))) + 1 if len(entries) > 1 else 1

    def masks(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """For each part the entries in the box of its radius."""
        out = np.full(len(parts), np.uint64(2**64 - 1))
        for k, (values, prefix) in enumerate(zip(self.sorted, self.prefix)):
            low, high = np.searchsorted(values, parts[:, k] - radius, "left"), np.searchsorted(values, parts[:, k] + radius, "right")
            out &= prefix[high] ^ prefix[low]
        return out

    def best(self, parts: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each part's candidates the nearest, the lowest of several, and its squared distance."""
        at, least = np.zeros(len(parts), np.int64), np.full(len(parts), np.iinfo(np.int64).max)
        left, masks = np.flatnonzero(masks), masks.copy()
        while len(left):
            m = masks[left]
            lowest = m & (~m + np.uint64(1))
            entry = np.bitwise_count(lowest - np.uint64(1)).astype(np.int64)
            far = ((parts[left] - self.entries[entry]) ** 2).sum(axis=1)
            closer = far < least[left]
            at[left[closer]], least[left[closer]] = entry[closer], far[closer]
            masks[left] = m ^ lowest
            left = left[masks[left] != 0]
        return at, least

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each part's nearest entry."""
        at, far = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        left, radius = np.arange(len(parts)), np.full(len(parts), self.radius, np.int64)
        while len(left):
            masks = self.masks(parts[left], radius)
            found, least = self.best(parts[left], masks)
            done = least <= radius * radius
            at[left[done]], far[left[done]] = found[done], least[done]
            again = ~done
            radius = np.where(masks != 0, np.sqrt(np.where(masks != 0, least, 0).astype(np.float64)).astype(np.int64) + 1, 2 * radius + 1)[again]
            left = left[again]
        return at, far


@dataclass
class Codebooks:
    """books: an array (entries x width) for each part position; length: that of the vectors."""

    books: list[np.ndarray]
    length: int

    @property
    def width(self) -> int:
        return self.books[0].shape[1]

    def sha256(self) -> str:
        """Of all entries' components as decimal numbers, by part, entry and position."""
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.ravel().tolist()).encode()).hexdigest()

    def cut(self, vectors: np.ndarray) -> np.ndarray:
        """rows x parts x width, filled up with zeros."""
        parts = len(self.books)
        return np.pad(vectors, ((0, 0), (0, parts * self.width - vectors.shape[1]))).reshape(len(vectors), parts, self.width)

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rows x parts: indices and squared distances."""
        cut = self.cut(vectors)
        found = [Slices(b).nearest(np.ascontiguousarray(cut[:, p])) for p, b in enumerate(self.books)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _vectors(df: DataFrame, vector: str, length: int, *more: Column) -> DataFrame:
    """`x`, the integers of the vectors that count, and more."""
    limit = isqrt(2**62 // max(1, length)) // 2
    kept = df.where(finite(F.col(vector)) & (F.size(vector) == length))
    return kept.select(*more, integers(F.col(vector), limit).alias("x"))


def train(df: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks that begin as the parts of the first `entries` rows by key, after `rounds` rounds; None without vectors.

    The driver sees the codebooks only.
    """
    length = usual_length(df, vector)
    if not length:
        return None
    ship(df.sparkSession)
    rows = _vectors(df, vector, length, F.col(key).alias("id"))
    width = -(-length // parts)
    first = np.array([r["x"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()], dtype=np.int64)
    blank = Codebooks([np.zeros((1, width), np.int64)] * parts, length)
    books = Codebooks([np.ascontiguousarray(b) for b in blank.cut(first).transpose(1, 0, 2)], length)
    for _ in range(rounds):
        books = _round(rows.select("x"), books)
    return books


def _round(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry replaced by the floored mean of the parts that are nearest to it; unused entries stay."""
    parts, width, d = len(books.books), books.width, books.length
    names = [f"s{k}" for k in range(width)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = parts * 64
        count, total = np.zeros(size, np.int64), np.zeros((size, width), np.int64)
        for b in batches:
            cut = books.cut(v := matrix(b.column("x"), d)).reshape(-1, width)
            slot = (books.assign(v)[0] + 64 * np.arange(parts)).ravel()
            count += np.bincount(slot, minlength=size)
            np.add.at(total, slot, cut)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), *[pa.array(total[used, k]) for k in range(width)]], names=["at", "n", *names])

    found = rows.mapInArrow(sums, "at long, n long, " + ", ".join(f"{c} long" for c in names))
    found = found.groupBy("at").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", *names)])
    new = [b.copy() for b in books.books]
    for r in found.collect():  # parts x entries rows at most
        new[r["at"] // 64][r["at"] % 64] = [int(r[c]) // int(r["n"]) for c in names]
    return Codebooks(new, d)


def encoded(df: DataFrame, books: Codebooks, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id", "label")) -> DataFrame:
    """The columns `keep` of the rows whose vectors count, code (bytes, one a part) and error (squared distances, summed over the parts)."""
    ship(df.sparkSession)
    rows = _vectors(df, vector, books.length, F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, far = books.assign(matrix(b.column("x"), books.length))
            codes = pa.array([c.tobytes() for c in at.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("row"), codes, pa.array(far.sum(axis=1))], names=["row", "code", "error"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, code binary, error long").select(*[F.col("row").getField(c).alias(c) for c in keep], "code", "error")


def decoded(codes: DataFrame, books: Codebooks, code: str = "code", out: str = "x") -> DataFrame:
    """codes with the integers that its codes stand for."""
    ship(codes.sparkSession)

    @F.pandas_udf("array<long>")
    def entries(column: pd.Series) -> pd.Series:
        joined = lambda c: np.concatenate([b[e] for b, e in zip(books.books, c)])[: books.length]
        return column.map(lambda c: None if c is None else joined(c))

    return codes.withColumn(out, entries(code))


def code_report(df: DataFrame) -> DataFrame:
    """vec_id, code (hex), error, label_error (summed over equal labels, nulls together), codebooks_sha256."""
    books = train(df)
    if books is None:
        none = df.select(F.col("vec_id"), *[F.lit(None).cast(k).alias(c) for c, k in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
        return none.where("false")
    rows = stored(encoded(df, books), "codes")
    sums = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))  # null beyond a long
    # a label may have a third of the rows: its sum is repeated and its rows are dealt out
    sums = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    dealt = rows.withColumn("dealt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(_SALTS)).cast("int"))
    joined = dealt.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("dealt") == F.col("salt")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))

"""Substring dedup by content-defined chunking with a gear rolling hash.

A text's words (lower-cased) are one line of bytes. The gear hash at a byte depends on the 32 bytes up to it; a chunk
ends where the hash at a word's end is greater than those at the REACH words before and after. Where words repeat with
a period of REACH or fewer, the greatest hashes tie; such a run is cut at the first of them and then at every next one
more than REACH words on, so its chunks are whole periods from the same word, wherever the run starts. So a cut depends
on a few words around it alone: an insertion moves the cuts near it and no others, and a passage is cut alike in all texts
that hold it. Chunks have more than REACH words, about twice that on average; regions without cuts are cut every
MAX_WORDS words. Chunks are deduplicated by a 128-bit digest: the smallest document that has one keeps it, and in the
other documents neighbouring chunks that are kept elsewhere make up a repeated passage if they have MIN_WORDS words
together. A passage of more than 50 words always has about 35 in whose cuts nothing else takes part, so MIN_WORDS is
well below that.

A digest's documents are never gathered: the first one is aggregated (before the shuffle, too), and the chunks are joined
with it under SALTS salts.

Defined results: a null or blank text has no chunks and no row. A document is an id and a text: rows equal in both are
one, and an id with several texts is several documents, the one whose text has the smallest digest first. Rows with a
null id are told apart by their text and come after all with an id; what they keep first has first_doc_id null. Ids may
be negative. Repeats within one document stay; an empty table gives no rows; other columns, whatever their names, are
ignored by the report and pass through `without_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_TABLE, ship, stored

REACH, MAX_WORDS, MIN_WORDS, SALTS = 4, 64, 18, 4
#: Fixed by a seed: a random 32-bit number for each byte.
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
_AT_ONCE = 1 << 20  # bytes whose hashes are computed at a time


def gear(line: np.ndarray) -> np.ndarray:
    """At each byte, the sum over the last 32 bytes of GEAR[byte] shifted by its distance: what the rolling hash holds."""
    h = GEAR[line]
    for k in (1, 2, 4, 8, 16):
        more = h[k:] + (h[:-k] << np.uint32(k))
        h = np.concatenate([h[:k], more])
    return h


def cuts(words: list[bytes]) -> np.ndarray:
    """Numbers of words that end a chunk: at least the last one."""
    ends = np.fromiter(accumulate(len(w) + 1 for w in words), np.int64, len(words)) - 2
    line = np.frombuffer(b" ".join(words), np.uint8)
    h = np.concatenate([gear(line[max(0, k - 31) : k + _AT_ONCE])[min(k, 31) :] for k in range(0, len(line), _AT_ONCE)])[ends]
    top, tied = np.ones(len(h), bool), np.zeros(len(h), bool)
    for k in range(1, min(REACH, len(h) - 1) + 1):
        top[k:] &= h[k:] >= h[:-k]
        top[:-k] &= h[:-k] >= h[k:]
        same = h[k:] == h[:-k]
        tied[k:] |= same
        tied[:-k] |= same
    last = -MAX_WORDS
    for k in np.flatnonzero(top & tied).tolist():
        if k - last > REACH:
            last = k
        else:
            top[k] = False
    found = np.flatnonzero(top)
    if not len(found) or found[-1] != len(words) - 1:
        found = np.append(found, len(words) - 1)
    gaps = np.diff(found, prepend=-1)
    if gaps.max() <= MAX_WORDS:
        return found
    return np.concatenate([np.append(np.arange(e - g + MAX_WORDS, e, MAX_WORDS), e) for e, g in zip(found, gaps)])


def text_chunks(text: str | None) -> list[tuple[int, int, int, int]]:
    """(first word, words, digest's halves as signed longs) of each chunk."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()
    if not words:
        return []
    out, low, half = [], 0, 1 << 63
    for end in cuts(words).tolist():
        d = xxhash.xxh3_128_intdigest(b" ".join(words[low : end + 1]))
        out.append((low, end + 1 - low, (d >> 64) - half, (d & (2 * half - 1)) - half))
        low = end + 1
    return out


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, tie, text: id and digest of the text together name a document, as an id may have several texts."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, tie, start, words, d1, d2."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ties, rows = [], [], []
            for doc_id, tie, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                found = text_chunks(text.as_py())
                ids += [doc_id] * len(found)
                ties += [tie] * len(found)
                rows += found
            columns = list(zip(*rows)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((ids, ties, *columns), kinds)], names=["doc_id", "tie", "start", "words", "d1", "d2"])

    return _narrow(docs).mapInArrow(run, "doc_id long, tie long, start int, words int, d1 long, d2 long")


def _dealt(rows: DataFrame) -> DataFrame:
    """rows of a stored table with a salt, so that the chunks of one digest, however many, are several tasks' work in a join."""
    return rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))


def _repeated(digests: DataFrame) -> DataFrame:
    """The other side: a row for each salt."""
    return digests.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, tie, start, n_words, first_doc_id: the passages that an earlier document keeps (of their first chunk).

    Documents are ordered by id, those without one last, and then by the digest of the text.
    """
    cut = stored(chunks(docs), "chunks")
    # most digests are in one document: these go by aggregates of plain numbers, before anything is ordered
    several = [F.min(c) != F.max(c) for c in ("doc_id", "tie")] + [F.count("doc_id").between(1, F.count("*") - 1)]
    held = cut.groupBy("d1", "d2").agg(reduce(Column.__or__, [F.coalesce(c, F.lit(False)) for c in several]).alias("several")).where("several").drop("several")
    shared = stored(_dealt(cut).join(_repeated(held), ["d1", "d2", "salt"]).drop("salt"), "shared-chunks")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    first = shared.groupBy("d1", "d2").agg(F.min(name).alias("first"))
    later = _dealt(shared).join(_repeated(first), ["d1", "d2", "salt"]).drop("salt").where(name != F.col("first"))
    # neighbours: a chunk starts where the one before it in the document ended
    by_doc = Window.partitionBy("doc_id", "tie").orderBy("start")
    rows = later.groupBy("doc_id", "tie", "start").agg(F.first("words").alias("words"), F.first("first.doc_id").alias("first_doc_id"))
    head = F.coalesce(F.lag(F.col("start") + F.col("words")).over(by_doc) != F.col("start"), F.lit(True))
    runs = rows.withColumn("head", head).withColumn("run", F.sum(F.col("head").cast("int")).over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("doc_id", "tie", "run").agg(F.min("start").alias("start"), F.sum("words").alias("n_words"), F.min_by("first_doc_id", "start").alias("first_doc_id"))
    return out.where(F.col("n_words") >= min_words).drop("run")


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, first_doc_id (null if that document has no id), start (word), n_words of each repeated passage."""
    return repeats(docs).select("doc_id", "first_doc_id", F.col("start").cast("long"), F.col("n_words").cast("long"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the repeated passages taken out of their texts, from the first to the last character of their words."""
    spans = repeats(docs, min_words).groupBy("doc_id", "tie").agg(F.array_sort(F.collect_list(F.struct("start", "n_words"))).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("of_id"), F.col("tie").alias("of_tie"), "spans")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("tie") == F.col("of_tie")), "left")

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        return pd.Series([_cut(t, s) for t, s in zip(texts, spans)])

    ship(docs.sparkSession)
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut("text", "spans"))
    return joined.select("row", text.alias("cut")).select(*[F.col("cut").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def _cut(text: str | None, spans) -> str | None:
    if text is None or spans is None:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    marks = np.frombuffer(raw.translate(WORD_TABLE), np.uint8) != 0x20
    edge = np.diff(marks.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for s in spans:
        first, n = s["start"], s["n_words"]
        out.append(raw[at : starts[first]])
        at = ends[first + n - 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")

"""Benchmark decontamination by a prefix-filtered set join.

A window is ten consecutive words of a benchmark item (an item of fewer words is one window). A text that contains a
window contains all of its shingles, so for full containment one necessary prefix shingle is enough: the one that the
fewest texts have. Three passes: count, over all texts, how many have each benchmark shingle; order every window's
shingles by that rarity and keep the first with its place; join the texts' shingles with those prefixes, drop what the
position or the text's length rules out, and compare the words of the window exactly. Near-copies would need more
prefix tokens; windows are exact.

What goes to all executors is a bitmap whose size follows the benchmark's up to MAX_BITS (32 MB). It only thins out the
shingles that are joined; the join and the comparison are exact.

Defined results: a null text or one without words has no hits; a null item id hits words but has no name to list;
repeated items and rows count once and each; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, ship, stored

WINDOW, SHINGLE = 10, 5
_CELL = 32768  # bits of a piece of the bitmap
MIN_BITS, MAX_BITS, BITS_EACH = 1 << 20, 1 << 28, 64  # of the bitmap: by the number of shingles, 32 MB at most
SALTS = 64  # parts that the rows of one text may fall into


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


def shingle_hashes(crcs: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of `width` words, from the words' crc32."""
    n = len(crcs) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, width, np.uint64)
    for j in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + crcs[j : j + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, found), np.uint64, len(found))


def windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item_id, line (the window's words, space-joined), len, shingles (hashes, in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(text)
                n = min(window, len(w))
                if not n:
                    continue
                k = min(shingle, n)
                h = shingle_hashes(word_hashes(w), k).view(np.int64).tolist()
                rows = range(len(w) - n + 1)
                lines = [b" ".join(w[i : i + n]).decode("utf-8", "surrogatepass") for i in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(lines), pa.string()), pa.array(lines), pa.array([n] * len(lines), pa.int32()), pa.array([h[i : i + n - k + 1] for i in rows], pa.list_(pa.int64()))],
                    names=["item_id", "line", "len", "shingles"],
                )

    ship(benchmark.sparkSession)
    return benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "item_id string, line string, len int, shingles array<long>")


def _bitmap(hashes: DataFrame) -> bytes:
    """Bit h mod its length is set for each h. The length, a power of two, follows the number of hashes up to MAX_BITS."""
    n_bits = min(MAX_BITS, max(MIN_BITS, 1 << (hashes.count() * BITS_EACH - 1).bit_length()))
    slot = F.pmod("h", F.lit(n_bits))
    cells = hashes.select((slot / _CELL).cast("int").alias("cell"), (slot % _CELL).alias("at")).groupBy("cell").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    out = bytearray(n_bits // 8)
    for r in cells:  # at most n_bits / _CELL of 4 KB
        out[r["cell"] * _CELL // 8 : (r["cell"] + 1) * _CELL // 8] = r["bits"]
    return bytes(out)


def _hits(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = h & np.uint64(8 * len(bitmap) - 1)
    return np.flatnonzero((bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)


def _salted(rows: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by digest, so that the rows of one text, which may be a third of all, are many tasks' work."""
    return rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), texts.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def _document_frequency(docs: DataFrame, bitmap: bytes, widths: list[int]) -> DataFrame:
    """h, texts: in how many texts a shingle of the bitmap occurs."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            found = []
            for t in b.column(0):
                crcs = word_hashes(words(t.as_py()))
                for k in widths:
                    h = shingle_hashes(crcs, k)
                    if len(at := _hits(h, bits)):
                        found.append(np.unique(h[at]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["h"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("texts"))


def prefixes(docs: DataFrame, found: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """line, len, h, at: each distinct window with its rarest shingle and that shingle's place in it."""
    lines = found.groupBy("line").agg(F.first("len").alias("len"), F.first("shingles").alias("shingles"))
    tokens = lines.select("line", "len", F.posexplode("shingles").alias("at", "h"))
    widths = sorted(r[0] for r in found.select(F.least("len", F.lit(shingle))).distinct().collect())
    counts = _document_frequency(docs, _bitmap(tokens.select("h")), widths)
    rarest = F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "h", "at"))
    return tokens.join(counts, "h", "left").groupBy("line", "len").agg(rarest.alias("r")).select("line", "len", F.col("r.h").alias("h"), F.col("r.at").alias("at"))


def _candidates(docs: DataFrame, bitmap: bytes, widths: list[int], window: int) -> DataFrame:
    """A row for each text (h null) and for each of its shingles in the bitmap, with the words around it."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            ids, md5, n_words, hs, ats, froms, around = [], [], [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                w = words(t)
                digest = None if t is None else hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest()
                ids.append(i), md5.append(digest), n_words.append(len(w)), hs.append(None), ats.append(None), froms.append(None), around.append(None)
                crcs = word_hashes(w)
                for k in widths:
                    h = shingle_hashes(crcs, k)
                    for at in _hits(h, bits).tolist():
                        low = max(0, at - window + 1)
                        ids.append(i), md5.append(digest), n_words.append(len(w)), hs.append(int(h[at].view(np.int64))), ats.append(at), froms.append(low)
                        around.append(b" ".join(w[low : at + window]).decode("utf-8", "surrogatepass"))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((ids, md5, n_words, hs, ats, froms, around), kinds)], names=["doc_id", "md5", "n_words", "h", "pos", "low", "around"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, md5 string, n_words long, h long, pos long, low long, around string")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, md5, n_words of each row of docs; md5, n_hit, items of each text with hits)."""
    found = stored(windows(benchmark, window, shingle), "windows")
    first = stored(prefixes(docs, found, shingle), "prefixes")
    widths = sorted(r[0] for r in found.select(F.least("len", F.lit(shingle))).distinct().collect())
    scan = stored(_candidates(docs, _bitmap(first.select("h")), widths, window), "candidates")
    joined = scan.where("h is not null").join(first.withColumnRenamed("at", "in_window"), "h")
    start = F.col("pos") - F.col("in_window")
    near = joined.withColumn("start", start).where((F.col("start") >= F.col("low")) & (F.col("start") + F.col("len") <= F.col("n_words")))
    here = F.array_join(F.slice(F.split("around", " "), (F.col("start") - F.col("low") + 1).cast("int"), "len"), " ")
    hits = stored(near.where(here == F.col("line")).select("md5", "start", "len", "line").distinct(), "hits")
    # words in the union of the intervals: each adds what lies beyond those that start before it
    spans = F.array_sort(F.collect_set(F.struct("start", "len")))
    union = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["start"] + s["len"] - F.greatest(a["end"], s["start"]))).alias("n"), F.greatest(a["end"], s["start"] + s["len"]).alias("end")),
    )["n"]
    n_hit = hits.groupBy("md5").agg(spans.alias("spans")).select("md5", union.alias("n_hit"))
    named = hits.select("md5", "line").distinct().join(found.where("item_id is not null").select("line", "item_id").distinct(), "line").select("md5", "item_id").distinct()
    items = named.groupBy("md5").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    return scan.where("h is null").select("doc_id", "md5", "n_words"), n_hit.join(items, "md5", "left")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    rows, texts = contamination(docs, benchmark)
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    rows, texts = _salted(rows, texts)
    return rows.join(texts, ["md5", "__salt"], "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text contains a window."""
    _, texts = contamination(docs, benchmark)
    row, texts = _salted(docs.withColumn("__md5", F.md5(F.col("text").cast("binary"))), stored(texts.select(F.col("md5").alias("__md5")), "contaminated"))
    return row.join(texts, ["__md5", "__salt"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

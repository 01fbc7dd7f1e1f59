"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most 2 r bits apart have a value within r bits of both. So every distinct fingerprint emits all
values within half the radius, these are shuffled, and fingerprints that meet on a value are linked and verified. All
that meet on a value lie in its ball, so a group holds at most 65 fingerprints at radius 2, however large the corpus
or its groups of copies: equal fingerprints were merged before.

Words are runs of anything but ASCII white space, A-Z lowered; shingles are three words, space-joined, repeats included
(fewer words: the whole sequence; none: fingerprint zero). A bit is set if it is set in over half of the XXH64 (seed 42)
values. These are the contract's three words; other widths are a parameter.

Two bits are few: texts of a similarity of 0.8 differ in about ten of 64. `near_links` therefore takes several short
fingerprints, in one of which a similar pair is at most two bits apart, lets them meet only where the texts share one of
their least shingles, and verifies by 512 bits and then by the shingles themselves.

Defined results: a null text is a text without words; null ids keep their row and do not name a component unless all of
it has null ids; equal rows are separate rows of one component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, ship, spread, stored
from .graph import components

WIDTH, SEED, RADIUS = 3, 42, 2
#: For groups by similarity: shingles of five words, fingerprints of 8 longs, of which 7 give 20 bits each to meet by, 3 least shingles.
SIMILARITY, SIMILAR_WIDTH, LONGS, TABLES, PART_BITS, MINIMA = 0.8, 5, 8, 7, 20, 3
DEVIATIONS = 3  # of a pair's differing bits, beyond which it isn't compared
_AT_ONCE = 1 << 16  # hashes whose bits are spread out at a time
_GROUP_CHARS = 500_000  # characters that are sketched at a time
_BLOCK = 1000  # texts with one short fingerprint that one row of blocks stands for
_SALTS = 8  # tasks among which the texts of one short fingerprint are dealt where they meet their head


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every run of `width` words, space-joined; of the whole sequence if there are fewer."""
    line, n = b" ".join(words), max(1, len(words) - width + 1)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    ends = starts[width : width + n] if len(words) >= width else [len(line) + 1]
    return np.array([digest(line[s : e - 1], SEED) for s, e in zip(starts, ends)], dtype=np.uint64).astype("<u8")


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    hashes = shingle_hashes(words, width)
    n = len(hashes)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, _AT_ONCE):
        part = hashes[k : k + _AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long), text_md5."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in b.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found), b.column("text_md5")], names=["doc_id", "fp", "text_md5"])

    return _narrow(docs).mapInArrow(run, "doc_id long, fp long, text_md5 string")


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def ball(radius: int) -> list[int]:
    """Masks (as signed longs) of at most radius // 2 bits, zero first."""
    masks = [sum(1 << b for b in bits) for r in range(radius // 2 + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct links (a > b) between distinct fingerprints `fp`: every component of the relation "at most radius bits apart" hangs together by them.

    radius must be even; each group links to its smallest member, as all of a group are within the radius of each other.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = ball(radius)
    around = lambda c: F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: m.bitwiseXOR(F.col(c))))
    variants = spread(fps, "fp", times=len(masks)).select("fp", around("fp").alias("variant"))
    # counted before they are ranked: nearly all values are met by one fingerprint only
    met = stored(variants.groupBy("variant").agg(F.min("fp").alias("b"), F.max("fp").alias("a"), F.count("*").alias("n")).where("n > 1"), "met")
    # the members of larger groups lie in the ball of the value that they met on
    crowded = spread(met.where("n > 2"), "variant", times=len(masks)).select("b", around("variant").alias("fp"))
    more = crowded.where("fp <> b").join(fps.select("fp"), "fp").select(F.col("fp").alias("a"), "b")
    return met.select("a", "b").unionByName(more).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """doc_id, text_md5, fp, component_id."""
    prints = stored(fingerprints(docs, width), "fingerprints")
    first = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    member = components(links(first.select("fp"), radius))
    named = (
        first.join(member, F.col("fp") == F.col("node"), "left").withColumn("component", F.coalesce("component", "fp"))
    )
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = stored(named.join(least, "component").select("fp", "component_id", "component"), "components")
    return prints.join(ids, "fp")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- by similarity: several short fingerprints -----------------------------------------------------------------------


def mixed_hashes(hashes: np.ndarray, j: int) -> np.ndarray:
    """The j-th of a family of independent mixings."""
    x = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (j + 1) & (2**64 - 1))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ x >> np.uint64(29)


def bit_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many values of each stretch (from one start to the next) have each of 64 bits. Bytes count up to 255 values at a time."""
    lens = np.diff([*starts, len(values)])
    n_parts = -(-lens // 255)
    first = np.cumsum(n_parts) - n_parts
    parts = np.repeat(starts, n_parts) + 255 * (np.arange(n_parts.sum()) - np.repeat(first, n_parts))
    out = np.empty((len(starts), 8, 8), np.int64)
    for k in range(8):
        lanes = values >> np.uint64(k) & np.uint64(0x0101010101010101)
        out[:, :, k] = np.add.reduceat(np.add.reduceat(lanes, parts).astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first)
    return out.reshape(len(starts), 64)


def sketch_all(texts: list[str | None], width: int, longs: int, minima: int) -> tuple[np.ndarray, list[list[int]]]:
    """For each text: that many fingerprints of 64 bits over its distinct shingles (zeros without words); its least hashes."""
    sets = []
    for t in texts:
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        sets.append(np.unique(shingle_hashes(w, width)) if w else np.empty(0, np.uint64))
    lens = np.array([len(x) for x in sets])
    some, out = np.flatnonzero(lens), np.zeros((len(texts), longs), np.uint64)
    if len(some):
        every, ends = np.concatenate(sets), np.cumsum(lens[some])
        for j in range(longs):
            sums = bit_sums(mixed_hashes(every, j), ends - lens[some])
            out[some, j] = np.packbits(2 * sums > lens[some][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out.view(np.int64), [x[:minima].view(np.int64).tolist() for x in sets]


def sketches(docs: DataFrame, width: int, longs: int, minima: int) -> DataFrame:
    """doc_id, text_md5, sketch, minima."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, at, found, least = b.column("text"), 0, [], []
            while at < len(texts):
                group, size = [], 0
                while at < len(texts) and size < _GROUP_CHARS:
                    group.append(texts[at].as_py())
                    size += len(group[-1] or "")
                    at += 1
                sketch, low = sketch_all(group, width, longs, minima)
                found += sketch.tolist()
                least += low
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_md5"), pa.array(found, kind), pa.array(least, kind)], names=["doc_id", "text_md5", "sketch", "minima"])

    return _narrow(docs).mapInArrow(run, "doc_id long, text_md5 string, sketch array<long>, minima array<long>")


def most_bits(similarity: float, bits: int, deviations: float = 2) -> int:
    """Differing bits that sketches of sets of that Jaccard similarity (and like size) hardly exceed, or with -2 hardly fall short of."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    return int(bits * p + deviations * sqrt(bits * p * (1 - p)))


def meetings(nodes: DataFrame, tables: int = TABLES, bits: int = PART_BITS) -> tuple[DataFrame, DataFrame]:
    """Texts by parts (node, h, sketch, minima, part) and parts that meet (h, variant, all: the parts that meet on that value, each with its head; a part alone, where several texts have it, under a null).

    A text with a partner of that similarity shares one of its least shingles with it (all but 0.2 ** 3 of such pairs),
    so balls are emitted for each least shingle that texts share, and parts only meet where they share it: strangers,
    however many, don't. At most bits + 1 parts meet on a value, by geometry. A part's head is one of its texts, drawn by part,
    so that one odd text isn't the head of all.
    """
    one = lambda x: F.lit(x).cast("long")
    masks = F.array(*map(one, [0, *(1 << k for k in range(bits))]))
    around = lambda c: F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col(c))))
    least = nodes.select("node", F.explode("minima").alias("h"))
    shared = least.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    able = stored(least.join(shared, "h").join(nodes, "node").select("node", "h", "sketch", "minima"), "sharing")
    # a part: the table's number and the low bits of its long
    numbered = F.transform(F.slice("sketch", 1, tables), lambda s, j: F.shiftleft(j.cast("long"), 32) + s.bitwiseAND(one((1 << bits) - 1)))
    parts = able.select("node", "h", "sketch", "minima", F.explode(numbered).alias("part"))
    drawn = F.min(F.struct(F.xxhash64("node", "h", "part").alias("order"), "node"))["node"]
    sizes = stored(parts.groupBy("h", "part").agg(F.count("*").alias("n"), drawn.alias("head")), "parts")
    variants = spread(sizes.select("h", "part", "head"), "h", "part", times=bits + 1).select("h", F.struct("part", "head").alias("own"), around("part").alias("variant"))
    met = stored(variants.groupBy("h", "variant").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("n")).where("n > 1"), "met-parts")
    # the members of larger groups lie in the ball of the value that they met on
    many = spread(met.where("n > 2").select("h", "variant"), "h", "variant", times=bits + 1).select("h", "variant", around("variant").alias("part")).join(sizes.select("h", "part", "head"), ["h", "part"])
    groups = met.where("n = 2").select("h", "variant", F.array("low", "high").alias("all")).unionByName(many.groupBy("h", "variant").agg(F.array_sort(F.collect_list(F.struct("part", "head"))).alias("all")))
    alone = sizes.where("n > 1").select("h", F.lit(None).cast("long").alias("variant"), F.array(F.struct("part", "head")).alias("all"))
    close = stored(groups.unionByName(alone), "close-parts")
    discard(met)
    return parts, close


def _differ(leaf: str, centre: str) -> list[Column]:
    return [F.col(leaf)[k].bitwiseXOR(F.col(centre)[k]) for k in range(LONGS)]


def star_links(nodes: DataFrame, parts: DataFrame, close: DataFrame, similarity: float) -> DataFrame:
    """Links (leaf, centre, apart) of each part's texts to its head, and of the heads of parts that meet on a value to the least part's.

    As many as there are texts and meetings; a pair of heads counts once, however often it meets.
    """
    sketch = lambda end: nodes.select(F.col("node").alias(end), F.col("sketch").alias(f"of_{end}"))
    several = close.where("variant is null").select("h", F.col("all")[0]["part"].alias("part"), F.col("all")[0]["head"].alias("centre")).join(sketch("centre"), "centre").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    texts = parts.select("h", "part", F.pmod(F.xxhash64("node"), F.lit(_SALTS)).cast("int").alias("salt"), F.col("node").alias("leaf"), F.col("sketch").alias("of_leaf"))
    found = texts.join(several, ["h", "part", "salt"]).select("leaf", "centre", "of_leaf", "of_centre")
    stars = close.where("variant is not null").select(F.col("all")[0]["head"].alias("centre"), F.explode(F.slice("all.head", 2, F.size("all"))).alias("leaf")).where("leaf <> centre").distinct()
    found = found.unionByName(stars.join(sketch("leaf"), "leaf").join(sketch("centre"), "centre").select("leaf", "centre", "of_leaf", "of_centre"))
    apart = reduce(Column.__add__, map(F.bit_count, _differ("of_leaf", "of_centre")))
    near = found.where("leaf <> centre").select(F.greatest("leaf", "centre").alias("leaf"), F.least("leaf", "centre").alias("centre"), apart.alias("apart"))
    return near.where(F.col("apart") <= most_bits(similarity, 64 * LONGS, DEVIATIONS)).distinct()


def _grouped(parts: DataFrame, close: DataFrame, member: DataFrame | None, bound: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """parts with each text's group (of member; else itself), and the meetings whose texts aren't all of one group, their parts with the least and the greatest group of their texts, and their bound (h, variant, all: part, a, b, bound)."""
    parts = parts.withColumn("group", F.col("node")) if member is None else parts.join(member, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
    ends = parts.groupBy("h", "part").agg(F.min("group").alias("a"), F.max("group").alias("b"), *(bound or [F.lit(0).alias("bound")]))
    each = close.select("h", "variant", F.explode("all.part").alias("part")).join(ends, ["h", "part"])
    own = F.struct("part", "a", "b", "bound")
    alone = each.where("variant is null and a <> b").select("h", "variant", F.array(own).alias("all"))
    met = each.where("variant is not null").groupBy("h", "variant").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.collect_list(own).alias("all"))
    return parts, met.where("a <> b").select("h", "variant", "all").unionByName(alone)


def unsettled(parts: DataFrame, close: DataFrame, member: DataFrame | None) -> DataFrame:
    """node: the texts that meet another one outside their group."""
    parts, close = _grouped(parts, close, member)
    met = close.select("h", F.explode("all.part").alias("part")).distinct()
    return parts.join(met, ["h", "part"], "left_semi").select("node").distinct()


def _pairs(close: DataFrame, may) -> DataFrame:
    """h, low, high: each pair of parts that meet, whose texts aren't all of one group and whose bounds allow a link; a part alone with itself."""
    apart = lambda x, y: F.least(x["a"], y["a"]) != F.greatest(x["b"], y["b"])
    both = lambda x: F.transform(F.filter("all", lambda y: (y["part"] > x["part"]) & apart(x, y) & may(x["bound"], y["bound"])), lambda y: F.struct(x["part"].alias("low"), y["part"].alias("high")))
    found = close.where("variant is not null").select("h", F.inline(F.flatten(F.transform("all", both)))).distinct()
    return found.unionByName(close.where("variant is null").select("h", F.col("all")[0]["part"].alias("low"), F.col("all")[0]["part"].alias("high")))


def shared_bounds(each: DataFrame, similarity: float) -> DataFrame:
    """node, n, n_shared, slots: how many shingles (node, h, n) a text has and shares with any other, and the slots of those.

    Two texts have at most n_shared - d shingles in common if d slots of one aren't slots of the other, so what these
    figures rule out is no link. Texts with less than that share of shared shingles have none at all and are left out.
    """
    lone = each.groupBy("h").agg(F.min("node").alias("node"), F.count("*").alias("k")).where("k = 1").select("node", "h")
    slots = [F.expr(f"bit_or(if((shiftright(h, 6) & {LONGS - 1}) = {k}, shiftleft(1L, cast(h & 63 as int)), 0L))") for k in range(LONGS)]
    found = each.join(lone, ["node", "h"], "left_anti").groupBy("node").agg(F.max("n").alias("n"), F.count("*").alias("n_shared"), F.array(*slots).alias("slots"))
    return found.where(F.col("n_shared") >= similarity * F.col("n"))


def _may_be_similar(one: Column | str, other: Column | str, similarity: float) -> Column:
    """Whether texts of these bounds (n: least, n_shared: most, every: slots of all of them, any: slots of one of them) can have that similarity."""
    one, other = (F.col(c) if isinstance(c, str) else c for c in (one, other))
    left = lambda x, y: x["n_shared"] - reduce(Column.__add__, [F.bit_count(x["every"][k].bitwiseAND(F.bitwise_not(y["any"][k]))) for k in range(LONGS)])
    common = F.least(left(one, other), left(other, one))
    return common >= similarity * (one["n"] + other["n"] - common)


def near_links(nodes: DataFrame, similarity: float, tables: int = TABLES, bits: int = PART_BITS, met: tuple[DataFrame, DataFrame] | None = None, member: DataFrame | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """Links (leaf, centre, apart: differing bits) between nodes (node, sketch, minima) whose sketches are near.

    All pairs of texts whose parts meet are compared by all bits: in a family of texts on one template, most that meet are
    strangers, so no one of them can stand for the others. Pairs that are in one group of `member` (node, component)
    already are never made: a part's texts meet by groups. With `bounds` (of shared_bounds, for all texts that may have a
    link still), pairs that these rule out aren't made either, first by parts, then by groups, then by texts. Texts of a group are dealt
    to blocks, so that no task has a hot part's pairs alone. A pair counts for its smallest common shingle and in the
    first table that has it only.
    """
    parts, close = met or meetings(nodes, tables, bits)
    size, may = [F.count("*").alias("size")], lambda one, other: F.lit(True)
    if bounds is None:
        parts = parts.withColumn("bound", F.lit(0))
        size.append(F.lit(0).alias("bound"))
    else:
        own = F.struct("n", "n_shared", F.col("slots").alias("every"), F.col("slots").alias("any"))
        parts, may = parts.join(bounds.select("node", own.alias("bound")), "node"), lambda one, other: _may_be_similar(one, other, similarity)
        over = lambda f, slots: F.array(*[f(F.col(f"bound.{slots}")[k]) for k in range(LONGS)]).alias(slots)
        size.append(F.struct(F.min("bound.n").alias("n"), F.max("bound.n_shared").alias("n_shared"), over(F.bit_and, "every"), over(F.bit_or, "any")).alias("bound"))
    parts, close = _grouped(parts, close, member, size[1:])
    blocks = stored(parts.groupBy("h", "part", "group").agg(*size).withColumn("n_blocks", F.ceil(F.col("size") / _BLOCK)), "part-groups")
    side = lambda c: blocks.select("h", F.col("part").alias(c), F.struct("group", "part", "size", "n_blocks").alias(f"of_{c}"), F.col("bound").alias(f"{c}_bound"))
    close = _pairs(close, may).join(side("low"), ["h", "low"]).join(side("high"), ["h", "high"])
    close = close.where("of_low.group <> of_high.group and (low <> high or of_low.group > of_high.group)").where(may(F.col("low_bound"), F.col("high_bound")))
    # the smaller side's texts come first, so that a large one is only joined where the pair is decided
    smaller = F.col("of_low.size") <= F.col("of_high.size")
    close = close.select("h", F.when(smaller, F.col("of_low")).otherwise(F.col("of_high")).alias("x"), F.when(smaller, F.col("of_high")).otherwise(F.col("of_low")).alias("y"))
    for c in ("x", "y"):
        close = close.select("*", F.col(f"{c}.part").alias(f"{c}_part"), F.col(f"{c}.group").alias(f"{c}_group"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{c}.n_blocks") - 1)).alias(f"{c}_block")).drop(c)
    dealt = parts.join(blocks.select("h", "part", "group", "n_blocks"), ["h", "part", "group"]).withColumn("block", F.pmod(F.xxhash64("node"), "n_blocks"))
    of = lambda c, end: dealt.select("h", *[F.col(k).alias(f"{c}_{k}") for k in ("part", "group", "block")], F.col("node").alias(end), F.col("sketch").alias(f"of_{end}"), F.col("minima").alias(f"least_{end}"), F.col("bound").alias(f"{end}_bound"))
    on = lambda c: ["h", f"{c}_part", f"{c}_group", f"{c}_block"]
    pairs = close.join(of("x", "leaf"), on("x")).join(of("y", "centre"), on("y"))
    differ, table = _differ("of_leaf", "of_centre"), F.shiftright("x_part", 32)
    apart = reduce(Column.__add__, map(F.bit_count, differ))
    first = [(table <= t) | (F.bit_count(differ[t].bitwiseAND(F.lit((1 << bits) - 1).cast("long"))) > RADIUS) for t in range(tables - 1)]
    once = reduce(Column.__and__, first, F.col("h") == F.array_min(F.array_intersect("least_leaf", "least_centre")))
    near = pairs.where(apart <= most_bits(similarity, 64 * LONGS, DEVIATIONS)).where(may(F.col("leaf_bound"), F.col("centre_bound"))).where(once)
    return near.select("leaf", "centre", apart.alias("apart"))


def ends(links: DataFrame) -> DataFrame:
    """node: the links' ends."""
    return links.select(F.explode(F.array("leaf", "centre")).alias("node")).distinct()


def text_shingles(some: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """node, h, n: the distinct shingles of these nodes' texts, one a row, with their number."""
    wanted = nodes.join(some, "node").select("node", F.col("best.doc_id").alias("__id"), F.col("best.text_md5").alias("__md5"))
    rows = _narrow(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_md5") == F.col("__md5")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, text in zip(b.column("node"), b.column("text")):
                h = np.unique(shingle_hashes(text.as_py().encode("utf-8", "surrogatepass").lower().split(), width)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.repeat(node, len(h)), pa.array(h), pa.repeat(pa.scalar(len(h), pa.int64()), len(h))], names=["node", "h", "n"])

    return rows.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(run, "node long, h long, n long")


def similar_links(links: DataFrame, each: DataFrame, similarity: float) -> DataFrame:
    """The links (leaf, centre) whose texts have that Jaccard similarity of distinct shingles, counted exactly.

    Shingles are joined one by one, so that neither a long text nor a centre with many links is one task's work.
    """
    leaf = links.join(each.select(F.col("node").alias("leaf"), "h", F.col("n").alias("n_leaf")), "leaf")
    both = leaf.join(each.select(F.col("node").alias("centre"), "h", F.col("n").alias("n_centre")), ["centre", "h"])
    counted = both.groupBy("leaf", "centre", "n_leaf", "n_centre").agg(F.count("*").alias("common"))
    return counted.where(F.col("common") >= similarity * (F.col("n_leaf") + F.col("n_centre") - F.col("common"))).select("leaf", "centre")


def similar_groups(links: DataFrame, each: DataFrame, similarity: float, bits: int, member: DataFrame | None = None) -> DataFrame:
    """node, component: of the graph of all links (leaf, centre, apart) that shingles confirm, and of the groups in member.

    A link goes without comparison only if links that were compared join its ends already. While links are many, one of
    each group is compared at a time, clear ones first; once that settles too few, all that are left are.
    """
    edges, before = None if member is None else member.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")), None
    links = links.withColumn("of_leaf", F.col("leaf")).withColumn("of_centre", F.col("centre"))
    while True:
        n, n_groups = links.agg(F.count("*"), F.countDistinct("of_leaf")).first()
        many = n > 4 * n_groups and (before is None or 2 * n <= before)
        some, before = links, n
        if many:
            order = F.struct((F.col("apart") > most_bits(similarity, bits, -2)).alias("doubtful"), "of_centre", "apart", "leaf", "centre")
            some = stored(links.groupBy("of_leaf").agg(F.min(order).alias("link")).select("link.leaf", "link.centre"), "first-links")
        good = similar_links(some.select("leaf", "centre"), each, similarity).select(F.greatest("leaf", "centre").alias("a"), F.least("leaf", "centre").alias("b"))
        edges = stored(good if edges is None else edges.unionByName(good), "similar-links")
        member = stored(components(edges), "groups")
        if not many:
            return member
        of = lambda c: member.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))  # noqa: E731,B023
        named = links.drop("of_leaf", "of_centre").join(some, ["leaf", "centre"], "left_anti").join(of("leaf"), "leaf", "left").join(of("centre"), "centre", "left")
        named = named.withColumn("of_leaf", F.coalesce("of_leaf", "leaf")).withColumn("of_centre", F.coalesce("of_centre", "centre"))
        links = stored(named.where("of_leaf <> of_centre"), "links-left")


def _rank():
    """Ascending in the order in which rows of a group are preferred."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.coalesce("text_md5", F.lit("")).alias("text_md5"))


def winners_by_similarity(docs: DataFrame, similarity: float = SIMILARITY, width: int = SIMILAR_WIDTH) -> DataFrame:
    """best: (none, doc_id, text_md5) of the row that stays of each group of texts linked by a Jaccard similarity of at least `similarity`.

    Links have their shingles compared, unless compared ones join their ends already. At 0.8 a part of 20 bits of both
    texts differs in two bits or fewer in two tables of five, so one of 7 tables finds 97 % of such pairs.
    """
    found = sketches(docs, width, LONGS, MINIMA).groupBy("sketch").agg(F.min(_rank()).alias("best"), F.min("minima").alias("minima"))
    nodes = stored(found.withColumn("node", F.monotonically_increasing_id()), "distinct-sketches")
    met = meetings(nodes)
    # groups by links to heads first, then by all pairs that these leave apart and that can be similar by the shingles they share
    links = stored(star_links(nodes, *met, similarity), "near-links")
    each = stored(text_shingles(ends(links), nodes, docs, width), "link-shingles")
    member = similar_groups(links, each, similarity, 64 * LONGS)
    discard(each)
    discard(links)
    each = stored(text_shingles(unsettled(*met, member), nodes, docs, width), "unsettled-shingles")
    bounds = stored(shared_bounds(each, similarity), "bounds")
    links = stored(near_links(nodes, similarity, met=met, member=member, bounds=bounds), "near-links")
    member = similar_groups(links, each, similarity, 64 * LONGS, member)
    member = member.withColumnRenamed("node", "member")
    named = nodes.join(member, F.col("node") == F.col("member"), "left").select("best", F.coalesce("component", "node").alias("component"))
    return named.groupBy("component").agg(F.min("best").alias("best"))


def one_of_each(docs: DataFrame, similarity: float | None = SIMILARITY, radius: int = RADIUS, width: int | None = None) -> DataFrame:
    """docs with one row of each group: that of the smallest id (null ids last), of equal ids the smallest digest of the text.

    Groups: of texts linked by that similarity; None: of fingerprints within the radius.
    """
    if similarity is None:
        best = near_duplicates(docs, radius, width or WIDTH).groupBy("component").agg(F.min(_rank()).alias("best"))
    else:
        best = winners_by_similarity(docs, similarity, width or SIMILAR_WIDTH)
    kept = best.select(F.col("best.doc_id").alias("__id"), F.col("best.text_md5").alias("__md5"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("md5"))
    won = row.join(kept, F.col("id").eqNullSafe(F.col("__id")) & (F.col("md5") == F.col("__md5")), "left_semi")
    return won.groupBy("id", "md5").agg(F.first("row").alias("row")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])

"""Groups by similarity in families of texts on one template."""

import random

import numpy as np
from pyspark.sql import functions as F

from heritree.llm import simhash


def nodes_of(spark, bits):
    """nodes (node, sketch, minima) of rows of 512 bits, all with one shingle in common."""
    longs = np.packbits(bits, axis=1, bitorder="little").view("<i8")
    return spark.createDataFrame([(k, s, [7]) for k, s in enumerate(longs.tolist())], "node long, sketch array<long>, minima array<long>")


def brute_links(bits):
    """All pairs that are near by all bits and at most two bits apart in some table's part."""
    out, most = {}, simhash.most_bits(simhash.SIMILARITY, 512, simhash.DEVIATIONS)
    for a in range(len(bits)):
        differ = (bits[a] != bits[:a]).reshape(a, 8, 64)
        parts, every = differ[:, : simhash.TABLES, : simhash.PART_BITS].sum(axis=2), differ.sum(axis=(1, 2))
        for b in np.flatnonzero((every <= most) & (parts.min(axis=1) <= 2)):
            out[a, int(b)] = int(every[b])
    return out


def test_links_of_a_template_family_are_brute_force(spark, monkeypatch):
    """Most that meet in a table are strangers by all bits; the pairs that aren't must not depend on one of them."""
    rng = np.random.default_rng(4)
    family = rng.integers(0, 2, 512) ^ (rng.random((300, 512)) < 0.12)
    twins = family[:60] ^ (rng.random((60, 512)) < 0.1)
    hot = rng.integers(0, 2, (60, 512))  # strangers with one table's part in common
    hot[:, : simhash.PART_BITS] = 1
    hot[31] = hot[30]
    hot[31, 64::8] ^= 1  # 56 bits, three in each other part
    bits = rng.permutation(np.concatenate([family, twins, hot])).astype(np.uint8)
    expected = brute_links(bits)
    for block in (simhash._BLOCK, 7):
        monkeypatch.setattr(simhash, "_BLOCK", block)
        found = simhash.near_links(nodes_of(spark, bits), simhash.SIMILARITY).collect()
        assert len(found) == len(expected) > 60
        assert {(max(r.leaf, r.centre), min(r.leaf, r.centre)): r.apart for r in found} == expected


def jaccard(a, b, width=simhash.SIMILAR_WIDTH):
    x, y = ({tuple(t.split()[k : k + width]) for k in range(len(t.split()) - width + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def clear_strangers():
    """Two texts of a family below the similarity whose sketches are as near as those of a clear pair and meet in a table."""
    r = random.Random(11)
    template = [f"word{k}" for k in range(125)]
    family = []
    for k in range(150):
        t = list(template)
        for at in (20, 60, 100):
            t[at] = f"own{k}at{at}"
        family.append(" ".join(t))
    bits = np.array([np.unpackbits(np.array(s, "<i8").view(np.uint8), bitorder="little") for s in simhash.sketch_all(family, simhash.SIMILAR_WIDTH, simhash.LONGS, simhash.MINIMA)[0]])
    return min((n, family[a], family[b]) for (a, b), n in brute_links(bits).items())


def test_clear_links_have_their_shingles_compared(spark):
    apart, a, b = clear_strangers()
    assert apart <= simhash.most_bits(simhash.SIMILARITY, 512, -2) and jaccard(a, b) < simhash.SIMILARITY
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert simhash.one_of_each(docs).count() == 2


def test_groups_of_many_links_are_those_of_all(spark):
    """Links by the dozen: the rounds leave the groups that comparing every link gives."""
    r = random.Random(12)
    texts = []
    for g in range(3):
        base = [f"g{g % 2}w{k}" if k < 100 else f"g{g}v{k}" for k in range(130)]
        for _ in range(9):
            t = list(base)
            t[r.randrange(130)] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(t))
    similar = [(a, b) for a in range(27) for b in range(a) if jaccard(texts[a], texts[b]) >= simhash.SIMILARITY]
    group = list(range(27))
    for _ in range(27):
        for a, b in similar:
            group[a] = group[b] = min(group[a], group[b])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = docs.selectExpr("doc_id as node", "struct(false as none, doc_id, md5(text) as text_md5) as best")
    links = spark.createDataFrame([(a, b, 50) for a in range(27) for b in range(a)], "leaf long, centre long, apart int")
    each = simhash.text_shingles(simhash.ends(links), nodes, docs, simhash.SIMILAR_WIDTH)
    found = dict(map(tuple, simhash.similar_groups(links, each, simhash.SIMILARITY, 512).collect()))
    assert [found.get(k, k) for k in range(27)] == group and len(set(group)) < 27


def test_pairs_that_share_several_shingles_count_once(spark):
    rng = np.random.default_rng(5)
    one = rng.integers(0, 2, 512).astype(np.uint8)
    bits = np.stack([one, one, one, one])
    bits[1:, 511] ^= 1
    bits[2:, 510] ^= 1
    bits[3, 509] ^= 1
    longs = np.packbits(bits, axis=1, bitorder="little").view("<i8").tolist()
    nodes = spark.createDataFrame(list(zip(range(4), longs, [[-5, 7, 9], [-5, 7, 8], [7, 8, 9], [1, 2, 3]])), "node long, sketch array<long>, minima array<long>")
    assert sorted(sorted(r[:2]) for r in simhash.near_links(nodes, simhash.SIMILARITY).select("leaf", "centre").collect()) == [[0, 1], [0, 2], [1, 2]]


def test_pairs_at_the_similarity_are_found(spark):
    """Misses and false merges of the whole stage, apart: pairs of 0.80 to 0.83, and pairs of 0.70 to 0.79."""
    r = random.Random(21)
    rows, close, far = [], 0, 0
    for k in range(900):
        words = [f"d{k}w{j}" for j in range(r.randrange(150, 260))]
        copy, wanted = list(words), k % 3 < 2
        while (j := jaccard(" ".join(words), " ".join(copy))) > (0.83 if wanted else 0.79):
            copy[r.randrange(len(copy))] = f"x{r.getrandbits(40)}"
        if wanted and j >= simhash.SIMILARITY or not wanted and j >= 0.7:
            rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
            close, far = close + wanted, far + (not wanted)
    kept = {x.doc_id for x in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ids = {i for i, _ in rows if i % 2}
    found = sum(i not in kept for i in ids if i // 2 % 3 < 2)
    assert close > 400 and far > 200 and all(i in kept for i, _ in rows if i % 2 == 0)
    assert found >= 0.92 * close, (found, close)
    assert all(i in kept for i in ids if i // 2 % 3 == 2)


def test_bounds_rule_out_no_similar_pair(spark):
    """A family on one template with all shares of changed words: what the bounds leave has every link, and little else."""
    r = random.Random(31)
    template, texts = [f"w{k}" for k in range(140)], []
    for k in range(160):
        t = list(template)
        for at in r.sample(range(140), k % 16):
            t[at] = f"own{r.randrange(400)}"
        texts.append(" ".join(t[: r.randrange(110, 141)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = docs.selectExpr("doc_id as node", "struct(false as none, doc_id, md5(text) as text_md5) as best")
    bounds = simhash.shared_bounds(simhash.text_shingles(nodes.select("node"), nodes, docs, simhash.SIMILAR_WIDTH), simhash.SIMILARITY)
    own = bounds.selectExpr("node", "struct(n, n_shared, slots as every, slots as any) as bound")
    a, b = own.toDF("a", "a_bound"), own.toDF("b", "b_bound")
    left = {(x.a, x.b) for x in a.join(b, a.a > b.b).where(simhash._may_be_similar("a_bound", "b_bound", simhash.SIMILARITY)).collect()}
    similar = {(x, y) for x in range(160) for y in range(x) if jaccard(texts[x], texts[y]) >= simhash.SIMILARITY}
    assert similar <= left and len(similar) > 300 and len(left) < 1.3 * len(similar), (len(similar), len(left))
    # by groups: no group that has an end of a link is ruled out, and single texts are ruled out as before
    groups = own.selectExpr("node % 40 as g", "bound").groupBy("g").agg(F.struct(F.min("bound.n").alias("n"), F.max("bound.n_shared").alias("n_shared"), *[F.array(*[f(F.col("bound.any")[k]) for k in range(simhash.LONGS)]).alias(c) for c, f in (("every", F.bit_and), ("any", F.bit_or))]).alias("bound"))
    a, b = groups.toDF("a", "a_bound"), groups.toDF("b", "b_bound")
    met = {(x.a, x.b) for x in a.join(b, a.a != b.b).where(simhash._may_be_similar("a_bound", "b_bound", simhash.SIMILARITY)).collect()}
    assert {(x % 40, y % 40) for x, y in similar if x % 40 != y % 40} <= met

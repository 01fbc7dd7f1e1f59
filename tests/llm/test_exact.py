"""Operators against brute force, on odd rows and with clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from heritree.llm import decontamination, licenses, mixing, quality, sharding, simhash, substrings, token_counts, token_files

SPACE_WORD, WORD = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def bag(rows):
    return collections.Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_decontamination(request, rows, benchmark, which):
    windows = collections.defaultdict(set)
    for item, text in benchmark.collect():
        w = re.findall(WORD, lower(text))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(item)
    expected = collections.Counter()
    for doc_id, text, *_ in rows:
        w = re.findall(WORD, lower(text))
        hit, items = set(), set()
        for line, owners in windows.items():
            for k in range(len(w) - len(line) + 1):
                if tuple(w[k : k + len(line)]) == line:
                    hit.update(range(k, k + len(line)))
                    items |= owners - {None}
        expected[doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit)] += 1
    docs = request.getfixturevalue(which)
    assert bag(decontamination.contamination_report(docs, benchmark).collect()) == expected
    clean = decontamination.decontaminated(docs, benchmark)
    assert clean.columns == docs.columns
    assert clean.count() == sum(n for k, n in expected.items() if not k[-1])


def targets(sizes):
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    left, active, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while active:
        each = left / sum(weight[s] for s in active)
        over = [s for s in active if each * weight[s] > 2 * sizes[s]]
        for s in over or list(active):
            out[s] = 2 * sizes[s] if over else each * weight[s]
            left -= out[s]
            active.discard(s)
    return out


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_mixing(request, rows, which):
    docs = request.getfixturevalue(which)
    out = mixing.mix_report(docs).collect()
    sizes = collections.Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(re.findall(SPACE_WORD, text or ""))
    goal = targets(sizes)
    assert bag((r.doc_id, r.size) for r in out) == bag((i, len(re.findall(SPACE_WORD, t or ""))) for i, t, *_ in rows)
    taken = collections.Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) <= 1e-9 * (1 + goal[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 + 0.01 * goal[s] for s in goal)
    assert bag(out) == bag(mixing.mix_report(docs).collect())
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    got = collections.Counter()
    for r in mixed.collect():
        got[r.source] += len(r.text.split())
    assert all(got[s] == taken[s] for s in taken if s != "c")  # c's text holds white space beyond ASCII's


def test_rows_that_differ_in_other_columns_only_are_cut_alike(spark):
    text = " ".join(f"w{k}" for k in range(400))
    rows = [(1, text, "a", f"row {k}", {"k": k}) for k in range(12)] + [(2, text, "b", "x", {})]
    schema = "doc_id long, text string, source string, note string, more map<string,int>"
    mixes = [bag((r.note, r.text) for r in mixing.mixed_rows(spark.createDataFrame(x, schema).repartition(n), block_words=7).collect()) for x, n in ((rows, 1), (rows[::-1], 4))]
    assert mixes[0] == mixes[1]


@pytest.mark.parametrize("seed", [42, 7])
def test_each_shard_of_the_mix_takes_its_quota(spark, seed):
    sizes = {"a": [40, 1, 7, 300, 12] * 8, "b": [5] * 100, "c": [900], "d": [0, 0]}
    rows = [(k, " ".join(f"{s}{k}x{n}" for n in range(size)), s) for s, of in sizes.items() for k, size in enumerate(of)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    plan = mixing.quotas(mixing.targets(mixing._sized(docs, seed, [])), 16, 5).collect()
    want = {}
    for r in plan:
        ends = [min(16 * sum(r.quota[: k + 1]), 2 * r.source_size) for k in range(5)]
        want |= {(r.source, k): e - b for k, (b, e) in enumerate(zip([0, *ends], ends)) if e > b}
    got, words = collections.Counter(), collections.Counter()
    for r in mixing.mixed_rows(docs, seed, 16, 5, shard="in_shard").collect():
        got[r.source, r.in_shard] += len(r.text.split())
        words.update(r.text.split())
    assert dict(got) == want and max(words.values()) <= 2
    report = mixing.mix_report(docs, seed, 16, 5).collect()
    assert {(r.source, int(s)) for r in report for s in r.shards.split(",") if s} == set(want)
    assert sum(r.taken for r in report) == sum(want.values())


def test_quotas_are_highest_quotients(spark):
    import heapq

    t = spark.createDataFrame([("a", 0, 700, 611.0), ("b", 1, 400, 311.5), ("c", 2, 90, 64.5), ("d", 3, 0, 0.0), ("e", 4, 9, 13.0)], "source string, pos int, source_size long, target double")
    got = {r.source: r.quota for r in mixing.quotas(t, block_words=10, n_shards=4).collect()}
    seats, goal = collections.Counter(), {r.source: r.target for r in t.collect()}
    heap = [(-g, s, 0) for s, g in goal.items() if g]
    heapq.heapify(heap)
    for n in range(1, 101):
        q, s, k = heapq.heappop(heap)
        seats[s] += 1
        heapq.heappush(heap, (-goal[s] / (2 * k + 3), s, k + 1))
        if n % 25 == 0:
            assert {s: sum(q[: n // 25]) for s, q in got.items()} == {s: seats[s] for s in goal}


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_token_counts(request, rows, which):
    docs = request.getfixturevalue(which)
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = token_counts.pieces(path)

    def best(word):
        text, row = token_counts.MARK + word, [(0.0, 0)]
        for j in range(1, len(text) + 1):
            found = [(row[i][0] + scores[text[i:j]], row[i][1] - 1) for i in range(j) if text[i:j] in scores]
            if text[j - 1] not in scores:
                raw = text[j - 1].encode()
                found.append((row[j - 1][0] + sum(scores[f"<0x{b:02X}>"] for b in raw), row[j - 1][1] - len(raw)))
            row.append(max(found))
        return -row[-1][1], row[-1][0]

    known = {w: best(w) for _, t, *_ in rows for w in re.findall(SPACE_WORD, t or "")}
    expected = collections.Counter((i, len(w := re.findall(SPACE_WORD, t or "")), sum(known[x][0] for x in w)) for i, t, *_ in rows)
    out = token_counts.token_counts(docs, path).collect()
    assert bag((r.doc_id, r.n_pretokens, r.n_tokens) for r in out) == expected
    assert sum(r.score for r in out) == pytest.approx(sum(known[x][1] for _, t, *_ in rows for x in re.findall(SPACE_WORD, t or "")))


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_quality(request, rows, which):
    docs = request.getfixturevalue(which)
    expected = collections.Counter()
    for doc_id, text, *_ in rows:
        text = text or ""
        w = re.findall(SPACE_WORD, text)
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        twice = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
        lines = [x for x in text.split("\n") if re.search(SPACE_WORD, x)]
        expected[doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice), len(w) < 50 or 2 * len(twice) > len(w)] += 1
    out = quality.quality_report(docs).collect()
    assert bag(tuple(r)[:-1] for r in out) == expected
    assert not any(r.kept and r.base_failed for r in out)
    kept = quality.kept_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in out if r.kept) == [8, 9]


def test_verdict_does_not_depend_on_the_order(docs):
    from pyspark.sql import functions as F

    for rules in (quality.RULES, quality.RULES[::-1]):
        assert docs.where(quality.verdict(F.col("text"), rules).isNull()).count() == 2


def test_rules_are_ordered_by_rejections_per_cost(docs, tmp_path):
    names = {r.name for r in quality.RULES}
    assert {r.name for r in quality.ordered(docs)} == names and quality.ordered(docs)[0].name in ("few words", "many words")
    docs.repartition(40).write.parquet(f"{tmp_path}/many")
    many = docs.sparkSession.read.parquet(f"{tmp_path}/many")
    assert len(many.inputFiles()) < 17 or len(quality._some_files(many, 1).inputFiles()) == quality.SAMPLE_FILES
    assert {r.name for r in quality.ordered(many)} == names


def test_rules_cost_what_they_cost_alone(spark, sf_dir):
    """A rule's time among all others is its time alone: nothing that another rule computes is taken off it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    quality.measured(docs, quality.RULES)  # compiles
    together = quality.measured(docs, quality.RULES)
    for r in quality.RULES:
        rejected, ns = min((quality.measured(docs, [r])[r.name] for _ in range(2)), key=lambda x: x[1])
        assert together[r.name][0] == rejected
        if ns > 5000:  # less is the clock's own
            assert ns / 3 < together[r.name][1] < 3 * ns, (r.name, together[r.name], ns)
    assert min(together[n][1] for n in ("repeated lines", "word length", "repeated words")) > 3 * together["few words"][1]
    # with the report's figures there already, rules on those are nearly free
    given = quality.measured(docs, quality.RULES, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"))
    assert given["repeated words"][1] * 3 < together["repeated words"][1] and given["capitals"][1] > given["repeated words"][1]


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_token_files(request, rows, which):
    docs = request.getfixturevalue(which)
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    out = sorted(token_files.token_file_report(docs, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted((i for i, *_ in rows), key=lambda i: (i is None, i or 0))
    ids = collections.Counter()
    for doc_id, text, *_ in rows:
        a = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        ids[doc_id, len(a), zlib.crc32(a)] += 1
    assert bag((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == ids
    assert [r.start for r in out] == np.cumsum([0, *(r.n_tokens for r in out)])[:-1].tolist()
    small = token_files.write_shards(docs, path, shard_tokens=50)
    assert small.count() > 3
    assert sum(len(r.ids) for r in token_files.read_shards(small).collect()) == sum(r.n_tokens for r in out)


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_sharding(request, rows, which):
    docs = request.getfixturevalue(which)
    out = sharding.sharded_documents(docs, 4).collect()
    assert bag((r.doc_id, r.size, r.text_crc32) for r in out) == bag((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    per = collections.defaultdict(list)
    for r in out:
        per[r.shard].append(r.slot)
    assert sorted(per) == [0, 1, 2, 3] and all(sorted(s) == list(range(len(s))) for s in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    full = sharding.sharded_rows(docs, 4)
    assert [c for c in full.columns if c in docs.columns and c not in ("size", "shard", "slot", "text_crc32")] == [c for c in docs.columns if c not in ("size", "shard", "slot", "text_crc32")]
    assert full.count() == len(rows)


def test_communication_matrix_is_hypergeometric():
    rows, n = [7, 0, 13, 5, 100], 6
    m = sharding.communication_matrix(rows, n, 1)
    assert [sum(x) for x in m] == rows and {sum(c) for c in zip(*m)} <= {125 // n, 125 // n + 1}
    draws = [sharding.communication_matrix([6, 14], 4, seed)[0][0] for seed in range(4000)]
    # 6 of 20 rows, 5 of which go to the first shard: mean 1.5, variance 6 * .25 * .75 * 14 / 19
    assert abs(np.mean(draws) - 1.5) < 0.06 and abs(np.var(draws) - 0.829) < 0.08


def test_hypergeometric_probabilities_of_large_tables():
    from fractions import Fraction
    from math import comb, log

    for good, bad, draws in ((30, 50, 20), (5, 400, 300), (1000, 3000, 777)):
        p = draws / (good + bad)
        for x in range(max(0, draws - bad), min(good, draws) + 1, 7):
            exact = Fraction(comb(good, x) * comb(bad, draws - x), comb(good + bad, draws))
            found = sharding._log_binomial(x, good, p, 1 - p) + sharding._log_binomial(draws - x, bad, p, 1 - p) - sharding._log_binomial(draws, good + bad, p, 1 - p)
            assert found == pytest.approx(log(exact.numerator) - log(exact.denominator), rel=1e-9, abs=1e-9)
    # 1e11 rows: the chances near the mode still add up
    good, bad, draws = 10**10, 9 * 10**10, 10**5
    p = draws / (good + bad)
    of = lambda x: sharding._log_binomial(x, good, p, 1 - p) + sharding._log_binomial(draws - x, bad, p, 1 - p) - sharding._log_binomial(draws, good + bad, p, 1 - p)
    assert sum(np.exp(of(x)) for x in range(10_000 - 900, 10_000 + 901)) == pytest.approx(1, abs=1e-9)


def test_input_partitions_are_merged_for_the_matrix(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MATRIX_CELLS", 40)
    docs = spark.range(500).selectExpr("id as doc_id", "cast(id as string) as text").repartition(30)
    out = sharding.sharded_documents(docs, 4).collect()
    assert sorted(r.doc_id for r in out) == list(range(500)) and sorted((r.shard, r.slot) for r in out) == [(s, k) for s in range(4) for k in range(125)]


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_licenses(request, rows, which):
    docs = request.getfixturevalue(which)
    expected = collections.Counter()
    for doc_id, text, *_ in rows:
        w = re.findall(WORD, lower(text))
        places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        expected[doc_id, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))] += 1
    out = licenses.license_report(docs).collect()
    assert bag(tuple(r)[:6] for r in out) == expected
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in out)


def test_license_rules_suppress_what_they_contain(spark):
    texts = ["Licensed under CC BY-NC-SA 4.0.", "MIT License mit license", "SPDX-License-Identifier: MPL-2.0", "All rights reserved", "this submits nothing", "GNU Lesser General Public License 2.1"]
    out = [r.labels for r in licenses.license_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert out == ["cc-by-nc-sa", "mit", "mpl-2-0", "proprietary", "", "gpl,lgpl"]
    assert len(licenses.rules()) > 300


def brute_fingerprint(text):
    w = re.findall(SPACE_WORD, lower(text))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_simhash(request, rows, which):
    docs = request.getfixturevalue(which)
    prints = [brute_fingerprint(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    least = [min((rows[b][0] for b in range(len(rows)) if group[b] == group[a] and rows[b][0] is not None), default=None) for a in range(len(rows))]
    out = simhash.near_duplicate_report(docs).collect()
    assert bag(out) == bag((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, least))
    for similarity in (None, 0.8):
        kept = simhash.one_of_each(docs, similarity)
        assert kept.columns == docs.columns
        kept = kept.collect()
        assert len(kept) == len(set(group)) and {r.doc_id for r in kept} >= {1, 3, 6}


def test_similar_texts_are_grouped(spark):
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randrange(2, 8)))
    rows = []
    for k in range(120):
        words = [word() for _ in range(r.randrange(60, 300))]
        rows.append((3 * k, " ".join(words)))
        for j in (1, 2):
            copy = list(words)
            for at in r.sample(range(len(words)), max(1, len(words) * j // 100)):  # one or two of a hundred words: similarity about 0.9 and 0.82
                copy[at] = word()
            rows.append((3 * k + j, " ".join(copy)))
    kept = {x.doc_id for x in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {3 * k for k in range(120)} <= kept and len(kept) <= 120 + 0.1 * 240


def test_ball_links_reach_all_pairs(spark):
    import random

    r = random.Random(1)
    centres = [r.getrandbits(64) for _ in range(8)]
    values = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))) for c in centres for _ in range(25)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    from heritree.llm.graph import components

    got = {x.node: x.component for x in components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    group = {v: v for v in signed}
    for _ in range(30):
        for a in signed:
            for b in signed:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
    linked = {a for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == {v: group[v] for v in linked}


def brute_repeats(rows):
    """(doc_id, first_doc_id, start, n_words) from the chunks of each distinct (id, text), by dictionaries."""
    tie = lambda t: xxhash.xxh64_intdigest(t.encode(), 42)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    docs = sorted({(i is None, i or 0, signed(tie(t)), t) for i, t in rows if t is not None})
    first, out = {}, collections.Counter()
    cut = {d: substrings.text_chunks(d[3]) for d in docs}
    for d in docs:
        for _, _, *digest in cut[d]:
            first.setdefault(tuple(digest), d)
    for d in docs:
        run = None
        for start, n, *digest in [*cut[d], (None, 0)]:
            owner = first.get(tuple(digest))
            if owner and owner != d:
                run = run or [None if owner[0] else owner[1], start, 0]
                run[2] += n
            elif run:
                if run[2] >= substrings.MIN_WORDS:
                    out[(None if d[0] else d[1], *run)] += 1
                run = None
    return out


@pytest.mark.parametrize("which", ["docs", "clashing"])
def test_substrings(request, rows, which):
    docs = request.getfixturevalue(which)
    out = substrings.repeat_report(docs).collect()
    assert bag(out) == brute_repeats([(i, t) for i, t, *_ in rows])
    assert {(r.doc_id, r.first_doc_id) for r in out} == {(9, 8)} and sum(r.n_words for r in out) >= 60
    clean = substrings.without_repeats(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert "passage20" not in texts[9] and "head nine first" in texts[9] and "passage20" in texts[8]


def test_substrings_with_null_negative_and_repeated_ids(spark):
    import random

    r = random.Random(11)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(n))
    passage, other = words(80), words(80)
    rows = [(1, passage), (5, words(100) + " " + passage), (5, words(10)), (5, words(3) + " " + passage + " " + words(7)), (-4, other), (7, words(5) + " " + other)]
    rows += [(None, words(6) + " " + passage), (None, words(9) + " " + passage), (None, third := words(90)), (None, third + " " + words(40)), (7, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = substrings.repeat_report(docs).collect()
    assert bag(out) == brute_repeats(rows)
    assert {(x.doc_id, x.first_doc_id) for x in out} == {(5, 1), (7, -4), (None, 1), (None, None)}
    clean = substrings.without_repeats(docs)
    assert clean.count() == len(rows) and {len(x.text.split()) for x in clean.where("doc_id = 5").collect()} >= {10}
    # what is left of the passage are its few words at the edges, whose chunks reach beyond it
    assert all(len(set(x.text.split()) & set(passage.split())) < 60 for x in clean.where("doc_id = 5").collect())


def test_a_passage_is_found_wherever_it_stands(spark):
    import random

    r = random.Random(7)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(n))
    rows, pairs = [], 300
    for k in range(pairs):
        passage = words(51)
        rows += [(2 * k, words(r.randrange(60)) + " " + passage + " " + words(r.randrange(60))), (2 * k + 1, words(r.randrange(60)) + " " + passage + " " + words(r.randrange(60)))]
    rows += [(10_000 + k, words(200)) for k in range(100)]
    out = {(x.doc_id, x.first_doc_id) for x in substrings.repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {(2 * k + 1, 2 * k) for k in range(pairs)}
    assert out <= found and len(out) >= 0.99 * pairs


def test_gear_is_the_rolling_hash():
    line, h = np.frombuffer(b"some bytes, and then some more of them, over 32", np.uint8), 0
    for at, b in enumerate(line):
        h = (h << 1 & 0xFFFFFFFF) + int(substrings.GEAR[b]) & 0xFFFFFFFF
        assert int(substrings.gear(line)[at]) == h

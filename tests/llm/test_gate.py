"""The gate of the license scan lets every rule's text through."""

import random
import re

from pyspark.sql import functions as F

from heritree.llm import licenses


def test_every_text_of_every_rule_passes_the_gate(spark):
    rows, r = [], random.Random(1)
    for _, keyword, regex, _, _ in licenses.rules():
        texts = licenses.variants(regex)
        for text in texts if len(texts) < 20 else r.sample(texts, 20):
            text = text.replace("…", "and so on ")
            assert re.fullmatch(regex, text) and keyword in text
            rows += [(text,), ("_" + text.upper().replace(" ", "_") + "_",), ("so\n*" + text.replace(" ", ". -") + "*",)]
    shut = spark.createDataFrame(rows, "text string").where(~licenses._gate(F.col("text"))).collect()
    assert len(rows) > 5000 and not shut


def test_rules_are_distinct_and_many():
    from heritree.llm import signatures

    written = [x[3] for x in signatures.TEXTS + signatures.ADDRESSES + signatures.NOTICES]
    assert len(set(written)) == len(written) > 200
    assert len({r[2] for r in licenses.rules()}) == len(licenses.rules())


def brute_detections(line):
    """Every rule's leftmost matches, and what is left of them when each pair is compared."""
    found = []
    for nth, (label, _, regex, priority, score) in enumerate(licenses.rules()):
        for m in re.finditer(rf"(?<= ){regex}(?= )", line):
            start = line[: m.start()].count(" ") - 1
            found.append((start, start + m[0].count(" ") + 1, priority, nth, label, score))
    found.sort(key=lambda d: (d[0], -d[1], -d[2], d[3]))
    return suppressed(found)


def suppressed(found):
    """What is kept of (start, end, priority, ...), each pair compared: highest priority first, by what was kept before only."""
    kept = []
    for p in sorted({d[2] for d in found}, reverse=True):
        free = [d for d in found if d[2] == p and not any(o[0] < d[1] and d[0] < o[1] for o in kept)]
        kept += [d for k, d in enumerate(free) if not any(o[0] <= d[0] and d[1] <= o[1] and (o[:2] != d[:2] or j < k) for j, o in enumerate(free) if j != k)]
    return sorted(kept, key=lambda d: (d[0], -d[1], -d[2], d[3]))


def test_suppression_of_made_up_intervals(spark):
    r, rows = random.Random(8), [(0, [(0, 4, 5, 0, "B", 1.0), (2, 8, 2, 1, "A", 1.0), (6, 8, 2, 2, "C", 1.0)])]
    for k in range(1, 400):
        rows.append((k, sorted({(s := r.randrange(12), s + r.randrange(1, 7), r.randrange(5), n, f"l{n}", 0.5) for n in range(r.randrange(9))}, key=lambda d: (d[0], -d[1], -d[2], d[3]))))
    kind = "array<struct<start:int,minus_end:int,minus_priority:int,nth:int,label:string,score:double>>"
    df = spark.createDataFrame([(k, [(s, -e, -p, n, label, score) for s, e, p, n, label, score in found]) for k, found in rows], f"k int, found {kind}")
    got = {x.k: [(d["start"], -d["minus_end"], -d["minus_priority"], d["nth"]) for d in x.out] for x in df.select("k", licenses._kept(F.col("found")).alias("out")).collect()}
    for k, found in rows:
        assert got[k] == [d[:4] for d in suppressed(found)], found
    assert [n for *_, n in got[0]] == [0, 2]  # what a suppressed one touches stays


def test_suppression_is_brute_force(spark):
    r, rows = random.Random(4), []
    texts = [t for x in licenses.rules() for t in [r.choice(licenses.variants(x[2])).replace("…", "or so ")]]
    for k in range(300):
        parts = [r.choice(texts) for _ in range(r.randrange(1, 5))]
        words = r.choice([", ", " ", " or "]).join(parts).split(" ")
        if k % 3 == 0:  # parts of two that overlap
            words = words[: r.randrange(1, len(words) + 1)] + parts[0].split(" ")[r.randrange(len(parts[0].split(" "))) :]
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in licenses.license_scan(docs).collect()}
    for k, text in rows:
        line = " " + " ".join(re.findall(licenses.WORD, text.lower())) + " "
        expected = [(s, e, label) for s, e, _, _, label, _ in brute_detections(line)]
        assert [(d["start"], -d["minus_end"], d["label"]) for d in got[k].found or []] == expected, text


def test_texts_with_nothing_but_a_notice(spark):
    texts = ["This software is the confidential property of Acme.", "use _MPL 2.0_ here", "x_cc_by_4.0", "complaint simple"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [(r.labels, r.score) for r in licenses.license_report(docs).orderBy("doc_id").collect()] == [("proprietary", 1.0), ("mpl", 0.9), ("cc-by", 0.9), ("", 0.0)]

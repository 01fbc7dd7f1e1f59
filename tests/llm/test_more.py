"""Personal data, the wavelet matrix, empty tables, the pipeline."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest

from heritree.llm import decontamination, licenses, mixing, pii, quality, sharding, simhash, substrings, token_counts, token_files
from heritree.llm.wavelet import WaveletMatrix, build

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def test_base_spans():
    r = random.Random(5)
    for _ in range(5000):
        text = "".join(r.choice("ab.@%+-0123456789 ().x\n4٣") for _ in range(r.randrange(80)))
        assert pii.base_spans(text) == brute(text)


def test_the_field_learns_and_keeps_base_spans():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8)))
    key = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    make = [lambda: f"{word()}.{r.randrange(99)}@mail.example.com", lambda: "password=" + key(18), lambda: f'token = "{key(40)}"', lambda: f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}", lambda: "10.20.30.40", lambda: str(r.randrange(1900, 2100)), lambda: "x=3"]
    text = lambda: " ".join(x for _ in range(12) for x in (*[word() for _ in range(r.randrange(2, 9))], r.choice(make)()))
    model = pii.train([text() for _ in range(120)])
    seen = found = 0
    for _ in range(60):
        t = text()
        base, spans = pii.all_spans(t, model)
        assert base == brute(t) and set(base) <= set(spans)
        for m in re.finditer(r"password=\w+|token = \"\w+\"", t):
            seen += 1
            found += any(k == "secret" and s < m.end() and m.start() < e for k, s, e in spans)
        assert not any(t[s:e] in ("x=3",) or re.fullmatch(r"(19|20)\d\d", t[s:e]) for _, s, e in spans)
    assert seen > 50 and found >= 0.9 * seen


def paths(n, found):
    """All ways to cut n tokens into candidates with a kind and single tokens outside: lists of (first, last, kind, candidate)."""
    if not n:
        yield []
        return
    for head in paths(n - 1, found):
        yield [*head, (n - 1, n - 1, pii.OUT, None)]
    for c in found[n - 1]:
        for head in paths(c[0], found):
            for kind in range(pii.OUT):
                yield [*head, (c[0], n - 1, kind, c)]


def path_score(path, weights, links):
    before, out = pii.OUT, 0.0
    for _, _, kind, c in path:
        out += links[before, kind] + (sum(weights[f][kind] for f in c[3]) if c else 0.0)
        before = kind
    return out


TRAINING = ["call +1 (555) 010-9999 or 10.0.0.1 x", "token = abcdef0123456789ab 4111 1111 1111 1111", "mail a.b@c.example.com 2024 items=3"]


def sample_of(texts):
    lowest = pii.Lowest()
    for t in texts:
        for kinds, piece in pii.pieces(t):
            lowest.add(kinds, piece)
    return lowest.sample()


def test_the_likelihood_is_that_of_all_segmentations():
    rng = np.random.default_rng(3)
    sample = sample_of(TRAINING)
    data = pii.Likelihood(sample)
    w, links = rng.normal(size=(len(data.features), pii.OUT)), rng.normal(size=(pii.OUT + 1, pii.OUT + 1))
    value, by_w, by_links = data.gradient(w, links)
    weights, z = dict(zip(data.features, w)), 0.0
    for piece in sample:
        found = pii.candidates(piece[1], pii._tokens(piece))
        scores = np.array([path_score(p, weights, links) for p in paths(len(found), found)])
        z += np.log(np.exp(scores - scores.max()).sum()) + scores.max()
        best = max(paths(len(found), found), key=lambda p: path_score(p, weights, links))
        assert pii.SemiMarkov(weights, links).best(found) == [(pii.LABELS[k], *c[1:]) for _, _, k, c in best if c]
    assert value == pytest.approx((data.gold_x * w).sum() + (data.gold_links * links).sum() - z)
    for point, gradient in ((w, by_w), (links, by_links)):
        for _ in range(40):
            at = tuple(rng.integers(0, n) for n in point.shape)
            point[at] += 1e-5
            more = data.gradient(w, links)[0]
            point[at] -= 2e-5
            less = data.gradient(w, links)[0]
            point[at] += 1e-5
            assert gradient[at] == pytest.approx((more - less) / 2e-5, abs=1e-4)


def test_held_out_recall_by_kind(spark, sf_dir):
    """Trained on half of the documents, the field alone finds the labels of the other half, kind by kind, and little else."""
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/../sf0.1/documents.parquet").orderBy("doc_id").select("text").collect()]
    model = pii.train(texts[::2])
    seen, found, extra = collections.Counter(), collections.Counter(), 0
    for t in texts[1::2]:
        secrets = [("secret", *pii._trim(t, *m.span())) for m in pii._STRICT_SECRET.finditer(t)]
        gold = [*secrets, *(b for b in pii.base_spans(t) if not any(b[1] < e and s < b[2] for _, s, e in secrets))]
        spans = model.spans(t)
        for kind, start, end in gold:
            seen[kind] += 1
            found[kind] += any(k == kind and s < end and start < e for k, s, e in spans)
        extra += sum(not any(s < e2 and s2 < e for _, s2, e2 in gold) for _, s, e in spans)
    assert set(seen) == set(pii.LABELS) and all(found[k] >= 0.9 * seen[k] for k in seen) and extra <= 0.02 * sum(seen.values())


def test_personal_data(docs, rows, clashing):
    for d in (docs, clashing):
        out = pii.personal_data_report(d).collect()
        expected = collections.Counter()
        for doc_id, text, *_ in rows:
            n = collections.Counter(k for k, *_ in brute(text or ""))
            line = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(text or ""))
            expected[doc_id, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(line.encode()).hexdigest()] += 1
        assert collections.Counter(tuple(r)[:6] for r in out) == expected
        model = pii.fitted(d)
        every = [pii.all_spans(t, model)[1] for _, t, *_ in rows]
        assert collections.Counter(r.spans for r in out) == collections.Counter(",".join(f"{k}:{s}:{e}" for k, s, e in x) for x in every)
        assert sum(r.n_spans for r in out) == sum(map(len, every)) and sum(r.n_secret for r in out) == sum(k == "secret" for x in every for k, *_ in x)
        assert pii.redacted(d).columns == d.columns
    assert "jo.doe" not in " ".join(r.text or "" for r in pii.redacted(docs).collect())


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    tokens = (rng.zipf(1.3, 3000) % 500).astype(np.uint32)
    w = WaveletMatrix(build(tokens, np.array([1000, 1000, 3000]), [3, None, 5]))
    assert (w.tokens() == tokens).all() and w.doc_ids == [3, None, 5] and (w.document(2) == tokens[1000:]).all()
    assert all(w.access(i) == tokens[i] for i in range(0, 3000, 17))
    for c in (1, 2, 7, 450, 499, 100_000):
        at = np.flatnonzero(tokens == c)
        assert w.count(c) == len(at) and w.rank(c, 1500) == (tokens[:1500] == c).sum()
        assert all(w.select(c, k) == at[k] for k in range(0, len(at), 5))
    for n in (0, 1, 8, 511, 512, 513, 1024):
        assert (WaveletMatrix(build(tokens[:n], np.array([n]), [0])).tokens() == tokens[:n]).all()


def own_ids(coder, texts):
    return [np.frombuffer(x, coder.width).tolist() for x in coder.encode(texts)]


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, own, r = Tokenizer.from_file(path), token_files.Encoder(path), random.Random(3)
    letters = ["a", "B", "z", "É", "'s", "’", "!", "-", "_", "0", "9", "<|endoftext|>", "Σ", "İ", "ß", "́", "가", "\n", "\t", "\x1c", "\xa0", "日本", " ", " don't", " the"]
    letters += ["\u092c", "\u095c", "\u0986", "\u09dc", "\u09df", "\u0a33", "\u0a36", "\u0b21", "\u0b5c", "\u0f42", "\u0f43", "\u05d0", "\ufb1d", "\ufb2a", ".", ","]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(3000)]
    for k in range(0, len(texts), 100):  # words of earlier groups are known by then
        assert own_ids(own, texts[k : k + 100]) == [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in texts[k : k + 100]]


def test_encoder_with_every_letter_before_punctuation():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), token_files.Encoder(path)
    uniform = lambda c: 0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4 or c >= 0x20000  # noqa: E731  ideographs and Hangul: every 50th
    letters = [chr(c) for c in range(0x30000) if chr(c).isalpha() and (not uniform(c) or c % 50 == 0)]
    assert len(letters) > 20_000
    texts = [f"{c}. a{c}, {c}b! {c}" for c in letters]
    assert own_ids(own, texts) == [[*x.ids, 1] for x in plain.encode_batch(texts, add_special_tokens=False)]


def test_empty_tables(none, benchmark, no_items, docs):
    from heritree.llm.common import stored

    path, vocabulary = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    for out in (
        decontamination.contamination_report(none, benchmark), decontamination.decontaminated(none, benchmark), mixing.mix_report(none), mixing.mixed_rows(none), token_counts.token_counts(none, vocabulary),
        quality.quality_report(none), quality.kept_rows(none), token_files.token_file_report(none, path), sharding.sharded_documents(none), sharding.sharded_rows(none), pii.personal_data_report(none),
        licenses.license_report(none), simhash.near_duplicate_report(none), simhash.one_of_each(none), substrings.repeat_report(none), substrings.without_repeats(none),
    ):
        assert out.count() == 0
    assert decontamination.contamination_report(docs, no_items).where("contaminated").count() == 0
    assert stored(none, "t").count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from heritree.llm.common import read, stored

    docs = read(spark, sf_dir, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), "test-stage")
        counts.append(docs.count())
        if name != "shards":
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0 and counts[4] == counts[5]
    assert corpus_pipeline.run(spark, sf_dir).count() == counts[5]


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.mark.parametrize("text", ["", None, "a@b", "@@@@@", "1" * 100_000, "x" * 100_000 + "@", "+" * 5000, "1.2.3." * 5000])
def test_base_spans_of_odd_texts(text):
    pii.base_spans(text or "")


def test_addresses_with_many_zeros():
    zeros = "0" * 5000
    assert pii.base_spans(zeros + "1.2.3.4") == [("ip", 0, 5007)]
    assert pii.base_spans("1.2.3." + zeros + "255") == [("ip", 0, 5009)]
    assert pii.base_spans("1.2.3." + zeros) == [("ip", 0, 5006)] and pii.base_spans("1.2.3." + zeros + "256") == [] and pii.base_spans("9" * 5000 + ".2.3.4") == []

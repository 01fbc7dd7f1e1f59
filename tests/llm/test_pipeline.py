"""The pipeline's stages against brute force, and on odd, clashing and no rows."""

import collections
import itertools

import duckdb
import pytest

import corpus_pipeline
from heritree.llm import mixing, sql


def stages(spark, docs, sf_dir, tmp_path):
    """What each stage gives, written and read again."""
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        out.append(docs := spark.read.parquet(f"{tmp_path}/{k}"))
    return out


def shingles(text):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def one_of_each(docs):
    """Ids that stay of documents (id to text) when all pairs of a Jaccard similarity of 0.8 are linked."""
    sets, by = {i: shingles(t) for i, t in docs.items()}, collections.defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    head = {i: i for i in docs}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for a, b in {p for ids in by.values() for p in itertools.combinations(sorted(ids), 2)}:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            head[b] = a
    return {i for i in docs if find(i) == i}


def test_stages_by_brute_force(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    assert len(texts) == table.count()
    good, unique, clean, mixed, sharded = stages(spark, table, sf_dir, tmp_path)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({sql.QUALITY}) WHERE kept").fetchall()}
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(good) == sorted(kept)
    heads = one_of_each({i: texts[i] for i in kept})
    assert ids(unique) == sorted(heads)
    hit = {r[0] for r in con.execute(f"SELECT doc_id FROM ({sql.DECONTAMINATION}) WHERE contaminated").fetchall()}
    assert ids(clean) == sorted(heads - hit) and heads & hit
    assert all(df.columns == table.columns for df in (good, unique, clean, mixed))
    # the mix is what its report says of the clean documents
    report = {r.doc_id: (r.taken, r.source_size, r.target) for r in mixing.mix_report(clean).collect()}
    words = collections.Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    assert set(words) <= set(report) and all(abs(words[i] - taken) <= max(0, taken) for i, (taken, *_) in report.items())
    assert {i for i, (taken, *_) in report.items() if taken} == set(words)
    rows = sharded.collect()
    assert sorted(r.doc_id for r in rows) == ids(mixed)
    sizes = collections.Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values() if len(sizes) == 40 else [0]) <= 1 and all(sorted(r.slot for r in rows if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    assert all(r.size == len((r.text or "").encode()) + 16 for r in rows)


LINES = "the cat sat on a mat and saw every bird fly over our old house near that small lake while nobody else in town looked up from bread"


@pytest.mark.parametrize("which", ["docs", "clashing", "none"])
def test_odd_rows(request, spark, sf_dir, tmp_path, which):
    docs = request.getfixturevalue(which)
    if which != "none":  # rows that pass the rules: twice the same, a near copy, one without an id, one with a rare source
        long = lambda k: " ".join(f"{w}{'abcdefgh'[(k + i) % 8]}{'qrstuvwx'[(i * i + k) % 8]}" for i, w in enumerate(LINES.split() * 2))
        more = [(100, long(1), "en", "a", 1), (100, long(1), "en", "a", 1), (101, long(1) + " end", "en", "b", 1), (None, long(2), None, None, None), (102, long(3), "en", None, 1)]
        plain = spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long")
        docs = docs.unionByName(plain, allowMissingColumns=True)
    out = stages(spark, docs, sf_dir, tmp_path)
    counts = [df.count() for df in out]
    if which == "none":
        assert counts == [0] * 5
    else:
        ids = [r.doc_id for r in out[2].collect()]
        assert sorted(i for i in ids if i is not None and i >= 100) == [100, 102] and ids.count(None) == 1
        assert counts[0] >= counts[1] >= counts[2] > 0 and counts[3] == counts[4] > 0
    assert all(df.columns == docs.columns for df in out[:4])
    added = ("size", "text_crc32", "shard", "slot")
    assert [c for c in out[4].columns if c not in added] == [c for c in docs.columns if c not in added] and set(added) <= set(out[4].columns)

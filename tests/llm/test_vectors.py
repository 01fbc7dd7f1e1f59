"""Whitening and vector codes against plain numpy; roots and vectors against exact cases; odd rows."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from heritree.llm import exact_roots, sql, vector_codes, whitening

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int"


def integer_rows(rows, d):
    kept = [r for r in rows if r[1] is not None and len(r[1]) == d and all(c is not None and np.isfinite(c) for c in r[1])]
    return kept, np.floor(np.array([r[1] for r in kept], dtype=np.float32).astype(float) * 256).astype(np.int64).reshape(len(kept), d)


@pytest.fixture(scope="module")
def odd(spark):
    draw = random.Random(5)
    rows = [(k, [draw.gauss(0, 0.2) for _ in range(20)], k % 3 or None) for k in range(150)]
    rows += [(k, rows[k % 7][1], 1) for k in range(150, 190)] + [rows[3], rows[3], (None, rows[4][1], None), (None, None, None), (7, None, 2)]
    rows += [(300, [None] * 20, 1), (301, [NAN] + [0.1] * 19, 1), (302, [0.1] * 19 + [INF], 1), (303, [0.1, -INF] + [0.2] * 18, 1), (304, [], 1), (305, [0.5] * 19, 1), (306, [-0.0] * 20, 1), (2, [1.0] * 20, 1)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute_codes(rows, d, parts=16, entries=64, rounds=2):
    kept, x = integer_rows(rows, d)
    width = -(-d // parts)
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, x[k].tolist()))
    kept, x = [kept[k] for k in order], np.pad(x[order], ((0, 0), (0, parts * width - d))).reshape(len(kept), parts, width)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        far = ((x[:, :, None] - books[None]) ** 2).sum(axis=3)
        return far.argmin(axis=2), far.min(axis=2)

    for _ in range(rounds):
        at, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                if len(own := x[at[:, p] == e, p]):
                    books[p, e] = own.sum(axis=0) // len(own)
    at, far = assign()
    error = far.sum(axis=1).tolist()
    sums: dict = {}
    for r, e in zip(kept, error):
        sums[r[2]] = sums.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted(((r[0], bytes(a).hex(), e, sums[r[2]], digest) for r, a, e in zip(kept, at.astype(np.uint8), error)), key=repr)


def test_codes_of_odd_rows(odd):
    rows, df = odd
    found = vector_codes.code_report(df.withColumns({c: F.lit("own") for c in ("x", "row", "code", "error", "at", "n", "id", "of", "salt", "dealt", "label_error")}))
    assert sorted(map(tuple, found.collect()), key=repr) == brute_codes(rows, 20)


def test_codes_of_the_table_and_their_sql(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = sorted(map(tuple, vector_codes.code_report(df).collect()), key=repr)
    assert found == brute_codes([tuple(r) for r in df.collect()], 64)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert sorted(con.execute(sql.vector_codes()).fetchall(), key=repr) == found


def test_codes_of_few_and_no_rows(spark):
    empty = vector_codes.code_report(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and not empty.count()
    assert not vector_codes.code_report(spark.createDataFrame([(1, None, 1), (2, [NAN], 1), (3, [], None)], SCHEMA)).count()
    few = [(1, [0.5] * 16, None), (2, [0.25] * 16, None), (3, [1e30, -1e30] + [0.0] * 14, 4)]
    found = {r["vec_id"]: r for r in vector_codes.code_report(spark.createDataFrame(few, SCHEMA)).collect()}
    assert [found[k]["code"] for k in (1, 2)] == ["00" * 16, "01" * 16] and found[1]["label_error"] == 0 and found[3]["code"][:4] == "0202"


def test_codes_decode_to_their_entries(odd):
    rows, df = odd
    books = vector_codes.train(df)
    coded = vector_codes.encoded(df, books)
    _, x = integer_rows(rows, 20)
    assert coded.count() == len(x)
    for r in vector_codes.decoded(coded, books).collect():
        assert r["x"] == [int(v) for p, e in enumerate(r["code"]) for v in books.books[p][e]][:20]


@pytest.mark.parametrize("seed", range(6))
def test_slices_find_the_nearest(seed):
    draw = np.random.default_rng(seed)
    width, wide = int(draw.integers(1, 6)), int(draw.choice([2, 40, 10**6]))
    entries = draw.integers(-wide, wide, (int(draw.integers(1, 65)), width))
    parts = np.concatenate([draw.integers(-3 * wide, 3 * wide, (500, width)), entries, entries + 1])
    far = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    at, least = vector_codes.Slices(entries).nearest(parts)
    assert (at == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()


def check_whitening(rows, d, found):
    kept, x = integer_rows(rows, d)
    distinct = np.unique(x, axis=0)
    n, s = len(distinct), distinct.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(distinct.T, bias=True))
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    y = (x - s / n) @ vectors / np.sqrt(values)
    by = {}
    for r in found:
        by.setdefault((r["vec_id"], r["component"], round(abs(r["whitened"]), 6)), []).append(r)
        assert r["n"] == n and abs(r["identity_error"]) < 1e-9 and r["explained"] == pytest.approx(values[r["component"] - 1] / (x.shape[1] and np.trace(np.cov(distinct.T, bias=True))), rel=1e-9)
    assert len(found) == 4 * len(kept)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    wanted = sorted((repr(r[0]), c + 1, abs(y[k, c]), int(deviation[k])) for k, r in enumerate(kept) for c in range(4))
    got = sorted((repr(r["vec_id"]), r["component"], abs(r["whitened"]), r["deviation"]) for r in found)
    for a, b in zip(wanted, got):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-8) and a[3] == b[3]
    # one sign for all rows
    for c in range(4):
        own = {r["vec_id"]: r["whitened"] for r in found if r["component"] == c + 1}
        signs = {np.sign(own[r[0]] * y[k, c]) for k, r in enumerate(kept) if abs(y[k, c]) > 1e-6 and r[0] in own and abs(abs(own[r[0]]) - abs(y[k, c])) < 1e-8}
        assert len(signs) == 1


def test_whitening_of_odd_rows(odd):
    rows, df = odd
    found = whitening.whitening_report(df.withColumns({c: F.lit("own") for c in ("x", "row", "whitened", "n", "component", "whitened_deviation", "at", "value")}))
    check_whitening(rows, 20, found.collect())


def test_whitening_of_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    check_whitening([tuple(r) for r in df.collect()], 64, whitening.whitening_report(df).collect())


def test_whitening_without_variance(spark):
    none = whitening.whitening_report(spark.createDataFrame([], SCHEMA))
    assert none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and not none.count()
    assert not whitening.whitening_report(spark.createDataFrame([(1, [0.5, 1.0], 1), (2, [0.5, 1.0], 2), (3, None, 1)], SCHEMA)).count()
    line = whitening.whitening_report(spark.createDataFrame([(k, [k / 256, k / 128, 1.0], 1) for k in range(5)], SCHEMA)).collect()
    assert {r["component"] for r in line} == {1} and {r["explained"] for r in line} == {1.0} and sorted(r["whitened"] for r in line)[4] == pytest.approx(2**0.5)
    large = whitening.whitening_report(spark.createDataFrame([(1, [1e30, 0.0], 1), (2, [-1e30, 0.5], 1), (3, [0.0, 1e-9], 1)], SCHEMA)).collect()
    assert {r["deviation"] for r in large if r["vec_id"] == 1} == {None} and all(r["identity_error"] < 1e-4 for r in large)


def test_equal_eigenvalues_have_orthonormal_components(spark):
    rows = [(k, v, 1) for k, v in enumerate([[1.0, 0.0, 0.0], [-1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, -1.0, 0.0], [0.0, 0.0, 1.0], [0.0, 0.0, -1.0]])]
    model, error = whitening.fit(spark.createDataFrame(rows, SCHEMA))
    assert np.allclose(model.vectors @ model.vectors.T, np.eye(3), atol=1e-14) and error < 1e-12 and model.explained == pytest.approx([1 / 3] * 3)


def test_polynomial_by_remainders():
    draw = random.Random(3)
    for d in (1, 2, 5, 9):
        a = [[draw.randint(-50, 50) for _ in range(d)] for _ in range(d)]
        m = [[sum(x * y for x, y in zip(u, v)) for v in a] for u in a]
        if d == 5:  # zeros below the diagonal make pivots move
            m = [[v if abs(i - j) != 1 else 0 for j, v in enumerate(row)] for i, row in enumerate(m)]
        bound = 10**40
        primes = exact_roots.primes_for(bound)
        found = exact_roots.remaindered([exact_roots.polynomial_mod(np.array([[v % p for v in row] for row in m], dtype=np.int64), p) for p in primes], primes)
        # by Faddeev and LeVerrier, in integers
        c, b = [1], [[0] * d for _ in range(d)]
        for k in range(1, d + 1):
            b = [[sum(m[i][t] * b[t][j] for t in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
            c.append(-sum(sum(m[i][t] * b[t][i] for t in range(d)) for i in range(d)) // k)
        assert found == c[::-1]


def test_close_and_multiple_roots():
    def poly(roots):
        out = [1]
        for r in roots:
            out = [(out[k - 1] if k else 0) - r * (out[k] if k < len(out) else 0) for k in range(len(out) + 1)]
        return out

    big = 10**30
    found = exact_roots.largest_roots(poly([big, big - 1, 7, 7, 7, 3, 0, 0]), 6, big)
    assert [(m / 2**s, n) for m, s, n in found] == [(1e30, 1), (1e30, 1), (7.0, 3), (3.0, 1)]
    assert (found[0][0] >> found[0][1]) in (big, big - 1) and found[0][0] << found[1][1] > found[1][0] << found[0][1]
    assert exact_roots.largest_roots(poly([0, 0]), 2, 5) == [] and exact_roots.roots_above(poly([5, 5, 2]), 5, 0) == 0 and exact_roots.roots_above(poly([5, 5, 2]), 9, 1) == 2

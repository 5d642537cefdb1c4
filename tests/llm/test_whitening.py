"""Operator 12: exact sums, eigenvectors against known rational ones, and the query against plain numpy in exact arithmetic."""

from fractions import Fraction

import numpy as np
import pytest

from pricefold.llm import whitening as W


def reflected(values, seed):
    """(exact V as Fractions, its exact eigenvectors): a rational Householder matrix H, V = H diag(values) H."""
    rng = np.random.default_rng(seed)
    v = [int(x) for x in rng.integers(-9, 10, len(values))]
    v[0] = v[0] or 1
    vv = sum(x * x for x in v)
    h = [[Fraction(int(i == j)) - Fraction(2 * a * b, vv) for j, b in enumerate(v)] for i, a in enumerate(v)]
    n = len(v)
    full = [[sum(h[i][k] * values[k] * h[j][k] for k in range(n)) for j in range(n)] for i in range(n)]
    return full, np.array([[float(x) for x in row] for row in h])


def pair(full):
    hi, lo = (np.zeros((len(full),) * 2) for _ in range(2))
    for i, row in enumerate(full):
        for j, x in enumerate(row):
            hi[i, j], lo[i, j] = W.exact_pair(x.numerator, x.denominator)
    return hi, lo


@pytest.mark.parametrize("values", [
    [Fraction(9), Fraction(5), Fraction(3), Fraction(1), Fraction(1, 10), Fraction(1, 1000)],
    [Fraction(3) + Fraction(k, 10 ** 9) for k in range(7)],
    [Fraction(3) + Fraction(k, 10 ** 13) for k in range(5)] + [Fraction(1), Fraction(1) + Fraction(1, 10 ** 6)],
    [Fraction(2)] + [Fraction(1) + Fraction(1, 10 ** k) for k in (3, 6, 9, 12)],
])
def test_eigenvectors_to_double_precision_also_in_clusters(values):
    full, h = reflected(values, len(values))
    e, x = W.eigenvectors(pair(full))
    order = sorted(range(len(values)), key=lambda k: -values[k])
    want = h[:, order]
    want = want * np.sign(want[np.abs(want).argmax(0), np.arange(len(values))])
    flip = np.sign((want * x).sum(0))                   # two largest entries may tie
    assert np.abs(e - [float(values[k]) for k in order]).max() < 1e-14 * float(max(values))
    assert np.abs(x * flip - want).max() < 4e-16


def test_equal_eigenvalues_keep_an_orthonormal_basis():
    values = [Fraction(4)] * 3 + [Fraction(1)] * 2 + [Fraction(0)]
    full, _ = reflected(values, 4)
    e, x = W.eigenvectors(pair(full))
    assert np.allclose(e, [4, 4, 4, 1, 1, 0], atol=1e-14) and np.abs(x.T @ x - np.eye(6)).max() < 1e-15
    assert np.abs(pair(full)[0] @ x - x * e).max() < 1e-14


def test_pair_products_are_exact_to_a_hundred_bits():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(5, 70)) * 10.0 ** rng.integers(-6, 6, (5, 70)), rng.normal(size=(70, 4))
    hi, lo = W.matmul((a, a * 1e-17), (b, b * 1e-17))
    for i in range(5):
        for j in range(4):
            want = sum((Fraction(a[i, k]) + Fraction(a[i, k] * 1e-17)) * (Fraction(b[k, j]) + Fraction(b[k, j] * 1e-17)) for k in range(70))
            size = sum(abs(Fraction(a[i, k]) * Fraction(b[k, j])) for k in range(70))
            assert abs(Fraction(hi[i, j]) + Fraction(lo[i, j]) - want) < size * Fraction(1, 2 ** 96)


@pytest.mark.parametrize("largest", [50, 2 ** 20, 2 ** 30, 2 ** 46])
def test_gram_of_integers_is_exact(largest):
    y = np.random.default_rng(largest).integers(-largest, largest + 1, (700, 3))
    assert (W.exact_gram(y) == y.astype(object).T @ y.astype(object)).all()


def brute(rows):
    """{(id, component): (n, deviation, whitened up to sign, explained)} with exact sums; ids are unique."""
    kept = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    n, d = len(kept), len(kept[0][1])
    s = [sum(x[k] for _, x in kept) for k in range(d)]
    z = np.array([[n * x[k] - s[k] for k in range(d)] for _, x in kept], object)
    cov = (z.T @ z)
    cov = np.array([[float(Fraction(int(cov[i, j]), n ** 3)) for j in range(d)] for i in range(d)])
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    white = (z / n).astype(float) @ q / np.sqrt(e)
    return {(i, k + 1): (n, int((z[r] ** 2).sum()), white[r, k], e[k] / np.trace(cov))
            for r, (i, _) in enumerate(kept) for k in range(min(d, 32))}


def check(got, want):
    assert len(got) == len(want)
    sign = {}
    for r in got:
        n, dev, white, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, dev) and r.explained == pytest.approx(explained, rel=1e-9)
        s = sign.setdefault(r.component, np.sign(white) * np.sign(r.whitened) if abs(white) > 1e-3 else 0.0) or np.sign(white * r.whitened)
        assert r.whitened == pytest.approx(s * white, abs=1e-8)
        assert r.identity_error < 1e-10
    assert len({r.identity_error for r in got}) == 1


def test_query_matches_numpy(spark):
    import duckdb
    rows = duckdb.sql("select vec_id, embedding from '/root/testdata/sf0.001/embeddings.parquet'").fetchall()
    check(W.op12_embedding_whitening(spark, "/root/testdata/sf0.001").collect(), brute(rows))


def test_bad_vectors_go_and_clashing_columns_stay_out(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4) * [3, 2, 1, 9]]) for i in range(60)]
    rows += [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [1.0, float("nan"), 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, whitened double, _v string")
    kept = [(i, None if v is None else [None if c is None else np.float32(c) for c in v]) for i, v in rows]
    check(W.whiten(df.repartition(5)).collect(), brute(kept))
    extra = spark.createDataFrame([(200, [1.0, 2.0]), (201, []), (202, [1e30] * 4)], "vec_id long, embedding array<float>")
    check(W.whiten(df.select("vec_id", "embedding").unionByName(extra)).collect(), brute(kept))


def test_large_entries_are_exact_and_long_deviations_null(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.integers(-2 ** 39, 2 ** 39, 3)]) for i in range(40)]
    out = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = brute(rows)
    for r in out:
        dev = want[r.vec_id, r.component][1]
        assert r.deviation == (dev if dev < 2 ** 63 else None)
        assert r.explained == pytest.approx(want[r.vec_id, r.component][3], rel=1e-9) and r.identity_error < 1e-10


def test_no_rows_no_variance_repeats_and_null_ids(spark):
    kind = "vec_id long, embedding array<float>"
    assert W.whiten(spark.createDataFrame([], kind)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0])], kind)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, []), (2, [])], kind)).count() == 0
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0])]
    out = W.whiten(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.vec_id is None, r.vec_id, r.component) for r in out) == [(False, 1, 1), (False, 1, 1), (False, 2, 1), (True, None, 1)]
    assert {r.explained for r in out} == {1.0} and out[0].identity_error < 1e-12

"""Nearest-neighbour mutual information against every pair of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from pricefold.operators import features as FE
from pricefold.operators import neighbours as NB


def _psi(m):
    return -0.5772156649015329 + sum(1.0 / i for i in range(1, int(m)))


def _brute(rows, k):
    """[(x, y)] on the grid -> the estimate, from all pairs."""
    x, y = np.array(rows, dtype=np.int64).T
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, 2 ** 62)
    r = np.maximum(np.sort(d, axis=1)[:, k - 1], 1)[:, None]
    nx, ny = (dx < r).sum(axis=1) - 1, (dy < r).sum(axis=1) - 1
    return max(0.0, _psi(len(x)) + _psi(k) - np.mean([_psi(a + 1) + _psi(b + 1) for a, b in zip(nx, ny)]))


def _check(spark, long, k, cell_rows):
    got = {r.idx: r.mi for r in NB.nearest_mutual_info(long, k, cell_rows).collect()}
    rows = {}
    for r in NB.on_grid(long).collect():
        rows.setdefault(r.idx, []).append((r.x, r.y))
    assert set(got) == set(rows)
    for idx, pts in rows.items():
        if len(pts) <= k:
            assert got[idx] is None
        else:
            assert got[idx] == pytest.approx(_brute(pts, k), abs=1e-9)


def test_embeddings(spark):
    long = FE.vector_long(spark.read.parquet(f"{SF_SMALL}/embeddings.parquet"), "vec_id", "embedding", "label").where("idx < 6")
    _check(spark, long, 3, 8)


def test_ties_constants_and_small_features(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        a, b = rng.normal(), rng.normal()
        rows += [(0, a, a + 0.1 * b),                             # dependent
                 (1, a, b),                                       # independent
                 (2, 0.0 if i % 3 else a, b if i % 2 else 1.0),   # a hot value on both axes, equal rows
                 (3, 1.0, b),                                     # constant x
                 (4, float(i % 4), float(i % 4)),                 # few values, many equal rows
                 (5, a ** 5, float(i % 3))]                       # long tails
    rows += [(6, 1.0, 2.0), (6, 2.0, 3.0), (7, None, 1.0), (0, float("nan"), 1.0), (0, 1.0, None)]
    long = spark.createDataFrame(rows, "idx int, x double, y double")
    for cell_rows in (7, 64):
        _check(spark, long, 3, cell_rows)


def test_digamma(spark):
    got = spark.range(1, 40).select("id", NB.digamma(F.col("id")).alias("p")).collect()
    assert all(abs(r.p - _psi(r.id)) < 1e-12 for r in got)

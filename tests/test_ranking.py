"""Distributed exact ranks / percentiles against brute force, with a hot group."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricefold.operators import split as SP
from pricefold.operators.ranking import exact_percentiles, rank_within


def _skewed(spark, n=3000, seed=3):
    rng = np.random.default_rng(seed)
    g = np.where(np.arange(n) < n // 3, "hot", rng.choice(["a", "b", "c", "d"], n))  # a third in one group
    v = rng.normal(size=n).round(3)  # ties on purpose
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "v": v})
    return pdf, spark.createDataFrame(pdf)


def test_rank_within_matches_sort(spark):
    pdf, df = _skewed(spark)
    got = rank_within(df, ["v", "id"], ["g"], num_partitions=7).select("id", "rank").toPandas()
    exp = pdf.sort_values(["g", "v", "id"]).assign(rank=lambda d: d.groupby("g").cumcount())[["id", "rank"]]
    m = got.merge(exp, on="id", suffixes=("", "_exp"))
    assert len(m) == len(pdf) and (m["rank"] == m["rank_exp"]).all()


def test_exact_percentiles_match_numpy(spark):
    pdf, df = _skewed(spark)
    probs = [0.0, 0.1, 0.5, 0.95, 0.99, 1.0]
    got = exact_percentiles(df, "v", probs, ["g"]).toPandas()
    for (g, p), val in got.set_index(["g", "prob"])["value"].items():
        assert abs(val - np.percentile(pdf.loc[pdf.g == g, "v"], p * 100)) < 1e-9


@pytest.mark.parametrize("n", [1, 2, 999, 1000, 1001, 20_000])
def test_percentiles_with_two_thirds_equal_values(spark, n):
    rng = np.random.default_rng(n)
    v = np.where(rng.random(n) < 2 / 3, 0.0, rng.normal(size=n).round(2))
    df = spark.createDataFrame(pd.DataFrame({"v": v})).repartition(7)
    probs = [0.0, 0.001, 0.25, 0.3333, 0.5, 0.9, 0.999, 1.0]
    got = {r.prob: r.value for r in exact_percentiles(df, "v", probs).collect()}
    assert got == pytest.approx({p: np.percentile(v, p * 100) for p in probs}, abs=1e-12)


def test_percentiles_neither_sort_nor_move_the_rows(spark):
    df = spark.range(200_000).select(F.when(F.col("id") % 3 < 2, 0.0).otherwise(F.rand(1)).alias("v"), (F.col("id") % 2).alias("g"))
    plan = exact_percentiles(df, "v", [0.1, 0.5, 0.9], ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("groups", [[], ["g"]])
@pytest.mark.parametrize("bound", [40])
def test_large_brackets_are_narrowed_by_cells(spark, monkeypatch, bound, groups):
    from pricefold.operators import ranking
    monkeypatch.setattr(ranking, "_CELLS", 256)
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(size=3000), rng.normal(size=900) * 1e-9 + 5, [1e9, -1e9, 0.0], np.full(800, 2.5)])
    pdf = pd.DataFrame({"v": v, "g": np.where(np.arange(len(v)) % 3 == 0, None, "a")})
    probs = [0.0, 0.001, 0.25, 0.5, 0.8, 0.81, 0.999, 1.0]
    got = exact_percentiles(spark.createDataFrame(pdf, "v double, g string").repartition(5), "v", probs, groups, bound=bound).collect()
    for key in (["a", None] if groups else [None]):
        own = pdf.v if not groups else pdf.v[pdf.g.isna() if key is None else pdf.g == key]
        mine = {r.prob: r.value for r in got if not groups or r.g == key}
        assert mine == pytest.approx({p: np.percentile(own, p * 100) for p in probs}, rel=1e-12, abs=1e-300)


def test_percentiles_without_groups_join_nothing(spark, monkeypatch):
    from pricefold.operators import ranking
    plans, kept = [], ranking.stored

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)
    monkeypatch.setattr(ranking, "stored", seen)
    df = spark.range(5000).select(F.rand(1).alias("v"), (F.col("id") % 2).alias("g"))
    exact_percentiles(df, "v", [0.1, 0.9])
    assert plans and not any("Join" in p or "Cartesian" in p for p in plans)
    exact_percentiles(df, "v", [0.1, 0.9], ["g"])
    assert not any("Cartesian" in p or "NestedLoop" in p or "SortMergeJoin" in p for p in plans)


def test_percentiles_of_null_groups_and_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", float("nan")), ("a", None)], "g string, v double")
    assert [(r.g, r.value) for r in exact_percentiles(df, "v", [0.5], ["g"]).collect()] == [(None, 2.0)]
    assert exact_percentiles(df.where("v > 99 and not isnan(v)"), "v", [0.5]).count() == 0


def test_stratified_folds_cover_each_id_once(spark):
    pdf, df = _skewed(spark)
    f = SP.stratified_kfold(df, "id", "v", n_splits=5).toPandas()
    assert sorted(f["id"]) == list(range(len(pdf)))
    sizes = f.groupby(["bin", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all()  # round robin inside each bin


def test_exact_sample_size(spark):
    pdf, df = _skewed(spark)
    s = SP.exact_sample(df, "id", frac=0.07)
    assert s.count() == round(0.07 * len(pdf))
    assert s.select("id").distinct().count() == s.count()
    order = sorted(range(len(pdf)), key=lambda i: (int(hashlib.md5(f"{i}:42".encode()).hexdigest()[:8], 16), i))
    assert {r.id for r in SP.exact_sample(df, "id", n=25).collect()} == set(order[:25])
    assert SP.exact_sample(df, "id", n=10 ** 6).count() == len(pdf) and SP.exact_sample(df, "id", n=0).count() == 0


def test_kfold_md5_value(spark):
    df = spark.createDataFrame([(1,)], "sample_id long")
    # md5('1:42') -> first 8 hex digits as a number, mod 5
    exp = int(hashlib.md5(b"1:42").hexdigest()[:8], 16) % 5
    assert SP.kfold(df, "sample_id", 5, 42).first()["fold"] == exp


def test_approx_percentiles_close_to_exact(spark):
    from pricefold.operators.ranking import approx_percentiles
    pdf, df = _skewed(spark)
    got = approx_percentiles(df, "v", [0.5, 0.95], ["g"]).toPandas()
    for (g, p), val in got.set_index(["g", "prob"])["value"].items():
        vals = pdf.loc[pdf.g == g, "v"].sort_values().values
        # rank error bound: n / accuracy, here below one rank
        assert vals[max(0, int(p * len(vals)) - 2)] <= val <= vals[min(len(vals) - 1, int(p * len(vals)) + 2)]

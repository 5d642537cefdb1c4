"""Steps that run over all rows: how often they do, and on how many tasks."""

import hashlib

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pricefold.functions import text as T
from pricefold.operators import features as FE
from pricefold.operators import models as MD
from pricefold.sources import tables as S


def test_char_drop_equals_single_draws_and_hashes_side_by_side(spark, monkeypatch):
    texts = [None, "", "a", "héllo 😀 wörld " * 9, "x" * 1203, "long key", "no key"]
    keys = ["1", "2", "-3", "12345678901", "9", "k" * 60, None]
    df = spark.createDataFrame(list(zip(keys, texts)), "k string, t string").coalesce(1)
    got = [r.x for r in df.select(T.char_drop(F.col("t"), F.col("k"), 0.3, seed=7).alias("x")).collect()]

    def draw(k, i):
        return int(hashlib.md5(":".join([*([k] if k is not None else []), str(i), "7"]).encode()).hexdigest()[:8], 16) / 4294967296.0
    assert got == ["".join(ch for i, ch in enumerate(t or "") if draw(k, i) >= 0.3) for k, t in zip(keys, texts)]
    called = []
    monkeypatch.setattr(T.hashlib, "md5", lambda *a: called.append(a))
    assert len(list(T._kept_chars(["abc" * 500] * 3, ["1", "22", None], 0.1, ":42"))) == 3 and not called


def test_a_tokens_vector_is_made_once_and_added_in_python(spark):
    df = spark.createDataFrame([("a b a",), (" b ",), (None,), ("",), ("c\ta",)], "t string").coalesce(1)
    out = df.select(FE.token_hash_embedding(F.col("t"), dim=4, seed=3).alias("e"))
    assert "md5" not in out._jdf.queryExecution().optimizedPlan().toString()         # no draw per row, token and dimension
    got = [r.e for r in out.collect()]

    def one(t):
        return np.array([int(hashlib.md5(f"{t}:{d}:3".encode()).hexdigest()[:8], 16) / 4294967296.0 * 2.0 - 1.0 for d in range(4)])
    want = [(one("a") + one("b") + one("a")) / 3, one("b"), np.zeros(4), np.zeros(4), (one("c") + one("a")) / 2]
    assert all(np.array_equal(g, w) for g, w in zip(got, want))


def test_svd_reduce_needs_one_pass_and_equals_numpy(spark):
    x = np.random.default_rng(2).random((60, 7)) * (np.arange(7) + 1)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, a array<double>").select("id", array_to_vector("a").alias("v"))
    group = "svd"
    spark.sparkContext.setJobGroup(group, group)
    reduced, values = MD.svd_reduce(df, "id", "v", 3)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) <= 4
    u, s, v = np.linalg.svd(x, full_matrices=False)
    assert values == pytest.approx(s[:3].tolist(), rel=1e-9)
    got = np.array([r.reduced for r in reduced.orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(x @ v[:3].T), atol=1e-9)


def test_the_catalog_is_read_by_as_many_tasks_as_cores(spark, tmp_path):
    spark.range(40).selectExpr("id AS p_partkey", "'a' AS p_name", "'b' AS p_brand", "'c' AS p_type", "1 AS p_size", "1.5D AS p_retailprice") \
        .coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    c = S.catalog(spark, str(tmp_path))
    assert c.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and c.count() == 40


def test_texts_are_cut_into_words_once_for_all_folds(spark, monkeypatch):
    rows = [(i, f"w{i % 7} word{i % 3} x{i % 5}y", float(i % 4), float(i), i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "sample_id long, text_clean string, a double, label double, fold int")
    pipe = MD.feature_pipeline("text_clean", ["a"], vocab=8)
    names, kept = [], MD.stored
    monkeypatch.setattr(MD, "stored", lambda d, name: names.append(name) or kept(d, name))
    folds = MD.prepared_folds(df, pipe, n_folds=3)
    assert names.count("feature-words") == 1 and len(names) == 4
    for k, (stages, train, test) in enumerate(folds):
        from pyspark.ml import PipelineModel
        assert train.count() == 20 and test.count() == 10
        want = {r.sample_id: r.features for r in PipelineModel(stages).transform(df).select("sample_id", "features").collect()}
        assert {r.sample_id: r.features for r in train.unionByName(test).collect()} == want
        assert PipelineModel(stages).stages[0].getInputCol() == "text_clean"

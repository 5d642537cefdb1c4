"""Metric golden values and post-processing."""

import math

from pyspark.sql import functions as F

from pricefold.operators import metrics as M
from pricefold.operators.postprocess import postprocess


def test_smape_worked_example(spark):
    df = spark.createDataFrame([(100.0, 120.0)], "y double, p double")
    v = df.select(M.smape_term("y", "p", "plain").alias("s")).first()["s"]
    assert math.isclose(v, 18.181818181818183)
    zero = spark.createDataFrame([(0.0, 0.0)], "y double, p double")
    assert zero.select(M.smape_term("y", "p").alias("s")).first()["s"] == 0.0
    assert zero.select(M.smape_term("y", "p", "zero_one").alias("s")).first()["s"] == 0.0


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "y double, p double")
    r = M.regression_metrics(df, "y", "p").first()
    assert math.isclose(r["rmse"], math.sqrt((0.25 + 0 + 1) / 3))
    assert math.isclose(r["mae"], 0.5)
    assert math.isclose(r["r2"], 1 - 1.25 / 2.0)
    const = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "y double, p double")
    assert M.regression_metrics(const, "y", "p").first()["r2"] == 1.0


def test_postprocess_half_even(spark):
    df = spark.createDataFrame([(-1.234,), (3.4567,), (0.125,)], "p double")
    got = [r["o"] for r in df.select(postprocess(F.col("p"), min_value=0.0).alias("o")).collect()]
    assert got == [0.0, 3.46, 0.12]


def test_skewtest_golden(spark):
    df = spark.createDataFrame([(750, 10.137520332825485)], "n long, g double")
    z = df.select(M.skewtest_z(F.col("n"), F.col("g")).alias("z")).first()["z"]
    p = M.skewtest_pvalue(z)
    assert math.isclose(p, 8.402757745457927e-197, rel_tol=1e-6)

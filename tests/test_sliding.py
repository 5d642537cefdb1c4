"""Every request's sliding percentiles against numpy, with a hot service dealt to many blocks."""

import numpy as np
import pandas as pd
import pytest

from pricefold.operators.sliding import OrderedWindow, sliding_percentiles


def requests(n=2500, seed=4):
    rng = np.random.default_rng(seed)
    service = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "lone"], n, p=[0.5, 0.49, 0.01]))
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 400, n), unit="s")
    value = np.where(rng.random(n) < 0.05, np.nan, rng.integers(0, 50, n) / 4)
    return pd.DataFrame({"service": service, "ts": ts, "event_id": rng.permutation(n), "latency_ms": value})


@pytest.mark.parametrize("window,block", [(50, 60), (50, 50), (1, 7), (5000, 100)])
def test_every_window_equals_numpy(spark, window, block):
    pdf = requests()
    df = spark.createDataFrame(pdf.assign(latency_ms=pdf.latency_ms.astype(object).where(pdf.latency_ms.notna(), None)),
                               "service string, ts timestamp, event_id long, latency_ms double").repartition(5)
    got = sliding_percentiles(df, window_rows=window, block_rows=block).toPandas().set_index("event_id")
    valued = pdf[pdf.latency_ms.notna()].sort_values(["ts", "event_id"])
    assert len(got) == len(valued)
    for name, own in valued.groupby("service"):
        values = own.latency_ms.to_numpy()
        for k, (i, lo) in enumerate(zip(own.event_id, np.maximum(0, np.arange(len(own)) - window + 1))):
            r = got.loc[i]
            assert (r.service, r["rank"], r.window_rows) == (name, k, k - lo + 1)
            assert (r.p50_ms, r.p95_ms, r.p99_ms) == pytest.approx(tuple(np.percentile(values[lo:k + 1], [50, 95, 99])))


def test_a_hot_service_is_many_tasks(spark):
    df = spark.createDataFrame(requests().assign(service="one").dropna())
    plan = sliding_percentiles(df, window_rows=10, block_rows=50)
    assert plan.count() == df.count()
    assert "hashpartitioning(_by" in plan._jdf.queryExecution().toString() and "_block" in plan._jdf.queryExecution().toString()


def test_no_requests(spark):
    df = spark.createDataFrame([], "service string, ts timestamp, event_id long, latency_ms double")
    assert sliding_percentiles(df).count() == 0


def test_ordered_window():
    rng, w, seen = np.random.default_rng(1), OrderedWindow(7), []
    for x in rng.integers(0, 5, 200).astype(float):
        w.push(x)
        seen = (seen + [x])[-7:]
        assert w.ordered[: w.n].tolist() == sorted(seen)

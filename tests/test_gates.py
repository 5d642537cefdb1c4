"""SLO gates and metric extraction on written-out rows."""

import json

from pricefold.operators import gates as G


def _metrics(spark, rows):
    return spark.createDataFrame(rows, "subject string, metric string, actual double")


def test_metrics_from_payloads(spark):
    bodies = {"plain": {"accuracy": "0.7", "smape": None, "error_rate": "x"},
              "nested": {"metrics": {"latency_ms": {"p95": 250}, "request_count": 0, "error_count": 3}, "accuracy": 1},
              "direct": {"latency_p95": 1.5, "latency_ms": {"p95": 9}, "error_rate": 0.1, "request_count": 10, "error_count": 9},
              "list": [1, 2]}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in bodies.items()] + [("none", None), ("bad", "{")], "subject string, body string")
    got = {}
    for r in G.extract_slo_metrics(df).collect():
        got.setdefault(r.subject, {})[r.metric] = r.actual
    assert got == {"plain": {"accuracy": 0.7}, "nested": {"latency_p95": 0.25, "error_rate": 3.0}, "direct": {"latency_p95": 1.5, "error_rate": 0.1}}


def test_canary_needs_latency_and_errors_only(spark):
    m = _metrics(spark, [("ok", "latency_p95", 2.4), ("ok", "error_rate", 0.01), ("late", "latency_p95", 2.6), ("late", "error_rate", 0.01),
                         ("blind", "accuracy", 0.9)])
    got = {(r.subject, r.metric): r.passed for r in G.canary_monitor(m).collect()}
    assert got == {("ok", "latency_p95"): True, ("ok", "error_rate"): True, ("late", "latency_p95"): False, ("late", "error_rate"): True,
                   ("blind", "latency_p95"): False, ("blind", "error_rate"): False}
    tight = {(r.subject, r.metric): r.passed for r in G.canary_monitor(m, {"max_latency_p95": 2.0}).collect()}
    assert tight["ok", "latency_p95"] is False


def test_production_overrides_require_their_metric(spark):
    m = _metrics(spark, [("a", "latency_p95", 1.0), ("a", "error_rate", 0.01)])
    got = {r.metric: r.passed for r in G.production_gate(m, {"min_accuracy": 0.5, "max_latency_p95": 0.5}).collect()}
    assert got == {"accuracy": True, "smape": True, "latency_p95": True, "error_rate": True, "accuracy_override": False, "latency_p95_override": False}


def test_training_gate(spark):
    rows = [("good", 20.0, 10.0), ("good", 99.0, 10.0), ("slow", 20.0, 4000.0), ("nan", float("nan"), 1.0), ("free", 30.0, None)]
    df = spark.createDataFrame(rows, "model string, smape double, total_seconds double")
    got = {r.model: (r.passed, r.failures) for r in G.training_gate(df).collect()}
    assert got == {"good": (True, ""), "slow": (False, "training_time"), "nan": (False, "smape_not_finite"), "free": (True, "")}

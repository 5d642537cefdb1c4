"""Service-level and promotion gates (SLO-1 .. SLO-5, MET-17, MET-21, MET-23).

Metrics arrive in long form (subject, metric, actual).  They are pivoted to one
row per subject, and the stage thresholds (fixed values) become column
expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Stage thresholds of the reference SLO config
SLO_THRESHOLDS = {
    "staging": {"min_accuracy": 0.65, "max_smape": 30.0, "max_latency_p95": 3.0, "max_error_rate": 0.05},
    "canary": {"min_accuracy": 0.68, "max_smape": 35.0, "max_latency_p95": 2.5, "max_error_rate": 0.03},
    "production": {"min_accuracy": 0.70, "max_smape": 30.0, "max_latency_p95": 2.0, "max_error_rate": 0.02},
}
# metric -> (threshold key, direction)
SLO_METRICS = {"accuracy": ("min_accuracy", ">="), "smape": ("max_smape", "<="),
               "latency_p95": ("max_latency_p95", "<="), "error_rate": ("max_error_rate", "<=")}
PROMOTION_MAX_ERROR_RATE = 0.05


MAX_TRAIN_SECONDS = 3600
SLO_NAMES = ["accuracy", "smape", "latency_p95", "error_rate", "success_rate", "throughput_qps"]


def extract_slo_metrics(payloads: DataFrame, col: str = "body", subject: str = "subject") -> DataFrame:
    """MET-17: (subject, metric, actual) from JSON payloads.  Metrics lie under ``metrics`` if that is an object,
    else at the top; text and numbers count, anything else is skipped.  Without ``latency_p95`` it is
    ``latency_ms.p95 / 1000``; without ``error_rate`` it is ``error_count / max(request_count, 1)``."""
    inner = F.get_json_object(F.col(col), "$.metrics")
    source = F.when(inner.startswith("{"), inner).otherwise(F.col(col))
    read = lambda path: F.get_json_object("_src", f"$.{path}").try_cast("double")               # noqa: E731
    found = {name: read(name) for name in SLO_NAMES}
    found["latency_p95"] = F.coalesce(found["latency_p95"], read("latency_ms.p95") / 1000.0)
    found["error_rate"] = F.coalesce(found["error_rate"], read("error_count") / F.greatest(read("request_count"), F.when(
        read("request_count").isNotNull(), F.lit(1.0))))
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("actual")) for k, v in found.items()])
    return (payloads.select(F.col(subject).alias("subject"), source.alias("_src"))
            .select("subject", F.inline(pairs)).where("actual IS NOT NULL"))


def validate_metrics(metrics: DataFrame, thresholds: dict | None = None, stages: list[str] | None = None,
                     overrides: dict | None = None) -> DataFrame:
    """SLO-1: each stage's thresholds against (subject, metric, actual); an absent metric is not checked.
    ``overrides`` (threshold key -> limit, SLO-2) replace the stage's limits.  The metrics are pivoted to one row
    per subject (a fixed metric list); there is no join grid.  Output: subject, stage, metric, actual, threshold,
    passed."""
    t = thresholds or SLO_THRESHOLDS
    wide = metrics.groupBy("subject").pivot("metric", list(SLO_METRICS)).agg(F.first("actual"))
    checks = []
    for stage in stages or list(t):
        limits = dict(t[stage], **(overrides or {}))
        checks += [_check(stage, m, m, float(limits[key]), direction, False) for m, (key, direction) in SLO_METRICS.items()]
    return wide.select("subject", F.explode(F.array(*checks)).alias("c")).select("subject", "c.*")


def _check(stage: str, name: str, metric: str, limit: float, direction: str, required: bool):
    a = F.col(metric)
    ok = (a >= limit) if direction == ">=" else (a <= limit)
    return F.struct(F.lit(stage).alias("stage"), F.lit(name).alias("metric"), a.alias("actual"),
                    F.lit(limit).alias("threshold"), F.when(a.isNull(), F.lit(not required)).otherwise(ok).alias("passed"))


def production_gate(metrics: DataFrame, overrides: dict | None = None) -> DataFrame:
    """SLO-5: the production thresholds, plus one more check ``<metric>_override`` for each override given; an
    overridden metric that is absent fails."""
    wide = metrics.groupBy("subject").pivot("metric", list(SLO_METRICS)).agg(F.first("actual"))
    limits = SLO_THRESHOLDS["production"]
    checks = [_check("production", m, m, float(limits[key]), d, False) for m, (key, d) in SLO_METRICS.items()]
    for m, (key, d) in SLO_METRICS.items():
        if key in (overrides or {}):
            checks.append(_check("production", f"{m}_override", m, float(overrides[key]), d, True))
    return wide.select("subject", F.explode(F.array(*checks)).alias("c")).select("subject", "c.*")


def canary_monitor(metrics: DataFrame, overrides: dict | None = None) -> DataFrame:
    """SLO-4: latency and error rate only, both required; ``overrides`` replace the canary limits."""
    limits = dict(SLO_THRESHOLDS["canary"], **(overrides or {}))
    wide = metrics.groupBy("subject").pivot("metric", list(SLO_METRICS)).agg(F.first("actual"))
    checks = [_check("canary", m, m, float(limits[SLO_METRICS[m][0]]), "<=", True) for m in ("latency_p95", "error_rate")]
    return wide.select("subject", F.explode(F.array(*checks)).alias("c")).select("subject", "c.*")


def training_gate(report: DataFrame, max_train_seconds: float = MAX_TRAIN_SECONDS) -> DataFrame:
    """SLO-3 per ``model`` of a training report (model, smape, total_seconds): passes when the best SMAPE is finite
    and the training time, where known, is within the limit."""
    best = report.groupBy("model").agg(F.min("smape").alias("best_smape"), F.max("total_seconds").alias("total"))
    bad = F.col("best_smape").isNull() | F.isnan("best_smape") | (F.abs("best_smape") == float("inf"))
    slow = F.coalesce(F.col("total") > max_train_seconds, F.lit(False))
    failures = F.concat_ws(",", F.when(bad, "smape_not_finite"), F.when(slow, "training_time"))
    return best.select("model", "best_smape", (~bad & ~slow).alias("passed"), failures.alias("failures"))


def gate_summary(checks: DataFrame) -> DataFrame:
    """Per subject and stage: passed when every check passed; failures listed."""
    return checks.groupBy("subject", "stage").agg(
        F.bool_and("passed").alias("passed"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("metric")))), ",").alias("failures"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("actual").isNull(), F.col("metric")))), ",")
        .alias("absent_metrics"))

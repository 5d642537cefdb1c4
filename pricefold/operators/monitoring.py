"""Latency and service statistics, alerts and retrain triggers
(MET-14, MET-15, WIN-1, WIN-5, TOP-2, ALR-1, ALR-2, RET-1, FLT-6, DAT-1).

Percentiles use the distributed exact percentile; everything else is one
aggregate.  Rule evaluation runs over small derived tables (one row per
feature or rule), never over raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import approx_percentiles, exact_percentiles, rank_within

# Fixed values (alert rules and retrain triggers of the reference config)
ALERT_RULES = {"psi_warn": 0.2, "psi_critical": 0.3, "alert_top_drift_features": 5,
               "latency_p95_total_seconds": 5.0, "latency_p95_seconds_per_row": 0.05}
RETRAIN_TRIGGERS = {"drift_psi_threshold": 0.3, "latency_p95_seconds_threshold": 5.0,
                    "max_days_since_last_train": 7, "max_critical_drift_features": 0}


def latency_summary(events: DataFrame, exact: bool = True) -> DataFrame:
    """MET-14: runs, p50/p95/p99 of total seconds, p95 of seconds per row;
    an empty log gives zeros.  ``exact=False`` uses the bounded sketch."""
    long = events.select(F.col("total_seconds").cast("double").alias("total"),
                         F.col("seconds_per_row").cast("double").alias("per_row")) \
                 .unpivot([], ["total", "per_row"], "metric", "v")
    pct = (exact_percentiles if exact else approx_percentiles)(long, "v", [0.5, 0.95, 0.99], ["metric"])
    piv = pct.agg(
        F.max(F.when((F.col("metric") == "total") & (F.col("prob") == 0.5), F.col("value"))).alias("p50_total_seconds"),
        F.max(F.when((F.col("metric") == "total") & (F.col("prob") == 0.95), F.col("value"))).alias("p95_total_seconds"),
        F.max(F.when((F.col("metric") == "total") & (F.col("prob") == 0.99), F.col("value"))).alias("p99_total_seconds"),
        F.max(F.when((F.col("metric") == "per_row") & (F.col("prob") == 0.95), F.col("value")))
        .alias("p95_seconds_per_row"))
    pcols = ["p50_total_seconds", "p95_total_seconds", "p99_total_seconds", "p95_seconds_per_row"]
    runs = events.agg(F.count(F.lit(1)).alias("runs"))
    # two one-row results stacked and folded into one row (no join)
    both = runs.select("runs", *[F.lit(None).cast("double").alias(c) for c in pcols]) \
        .unionByName(piv.select(F.lit(None).cast("long").alias("runs"), *pcols))
    return both.agg(F.max("runs").alias("runs"), *[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in pcols])


SERVICE_COUNTS = {
    "requests": lambda: F.count(F.lit(1)), "errors": lambda: F.count_if(F.col("is_error")),
    "predict_rows": lambda: F.coalesce(F.sum("rows_scored"), F.lit(0)),
    "image_fallback": lambda: F.coalesce(F.sum("image_fallback_rows"), F.lit(0)),
    "text_fallback": lambda: F.coalesce(F.sum("text_fallback_rows"), F.lit(0)),
    "dq_passed": lambda: F.count_if(F.col("dq_policy") == "allow"), "dq_total": lambda: F.count("dq_policy"),
}


def service_counts() -> list:
    """Mergeable counters of MET-15, for batch and stream aggregates."""
    return [make().alias(name) for name, make in SERVICE_COUNTS.items()]


def with_rates(counts: DataFrame) -> DataFrame:
    """MET-15 rates; every denominator is 1 at least."""
    rate = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))                              # noqa: E731
    return (counts.withColumn("error_rate", rate("errors", "requests"))
            .withColumn("image_fallback_rate", rate("image_fallback", "predict_rows"))
            .withColumn("text_fallback_rate", rate("text_fallback", "predict_rows"))
            .withColumn("dq_pass_rate", rate("dq_passed", "dq_total")))


def service_metrics(requests: DataFrame, by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """MET-15: counters, error, fallback and data-quality pass rates and latency percentiles (ms) per service
    (``exact=False``: bounded sketch)."""
    by = list(by or [])
    base = with_rates(requests.groupBy(*by).agg(*service_counts()))
    pct = (exact_percentiles if exact else approx_percentiles)(requests, "latency_ms", [0.5, 0.95, 0.99], by)
    names = [("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99)]
    wide = pct.groupBy(*by).agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in names])
    if by:
        return base.join(wide, by, "left")
    both = base.unionByName(wide, allowMissingColumns=True)      # two one-row tables folded into one
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def rolling_latency_window(requests: DataFrame, window_rows: int = 5000, by: str = "service") -> DataFrame:
    """WIN-1: percentiles over each service's most recent ``window_rows`` requests (the service's bounded latency
    buffer, as of the end of the log).  A sketch of the times gives each service a cut that keeps little more than
    the window; only those rows are ranked by recency."""
    r = requests.withColumn("_at", F.unix_micros(F.col("ts")))
    grid = [1 - 2.0 ** -k for k in range(1, 13)] + [0.0]
    cuts = r.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_at", grid, 10_000).alias("q"))
    # the latest grid point that surely leaves window_rows newer requests (sketch error: n / 10,000 ranks); null: all rows
    cut = F.greatest(*[F.when((1 - p - 2e-4) * F.col("n") >= window_rows, F.col("q")[i]) for i, p in enumerate(grid)])
    newer = r.join(cuts.select(by, cut.alias("_cut")), by).where(F.col("_cut").isNull() | (F.col("_at") >= F.col("_cut")))
    ranked = rank_within(newer.select(by, "latency_ms", (-F.col("_at")).alias("_neg_ts"), (-F.col("event_id")).alias("_neg_id")),
                         ["_neg_ts", "_neg_id"], [by], rank_col="_recent")
    pct = exact_percentiles(ranked.where(F.col("_recent") < window_rows), "latency_ms", [0.5, 0.95, 0.99], [by])
    return pct.groupBy(by).agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n)
                                 for n, p in [("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99)]],
                               F.lit(window_rows).alias("window_rows"))


def rank_drift(drift: DataFrame) -> DataFrame:
    """WIN-5: rank features by psi (desc), ties by name.  The drift table has one
    row per feature, so a single ordered window is small."""
    return drift.withColumn("drift_rank", F.row_number().over(Window.orderBy(F.desc("psi"), "feature")))


def top_drift(drift: DataFrame, k: int = 20) -> DataFrame:
    """TOP-2: the k features with the largest PSI (TakeOrderedAndProject)."""
    return drift.orderBy(F.desc("psi"), "feature").limit(k)


def evaluate_alerts(drift: DataFrame, latency: DataFrame, rules: dict | None = None) -> DataFrame:
    """ALR-1: drift alerts per feature, latency alerts from the summary, each
    carrying the top-k drift features with their PSI.  Output: severity, alert_type,
    subject, value, threshold, top_drift_features (array of (feature, psi))."""
    r = dict(ALERT_RULES, **(rules or {}))
    d = drift.select(
        F.when(F.col("psi") >= r["psi_critical"], "critical").when(F.col("psi") >= r["psi_warn"], "warning")
         .alias("severity"),
        F.lit("drift").alias("alert_type"), F.col("feature").alias("subject"), F.col("psi").alias("value"),
        F.when(F.col("psi") >= r["psi_critical"], r["psi_critical"]).otherwise(r["psi_warn"]).alias("threshold"))
    lat = latency.select(F.explode(F.array(
        F.struct(F.when(F.col("p95_total_seconds") > r["latency_p95_total_seconds"], "critical").alias("severity"),
                 F.lit("latency").alias("alert_type"), F.lit("p95_total_seconds").alias("subject"),
                 F.col("p95_total_seconds").alias("value"),
                 F.lit(float(r["latency_p95_total_seconds"])).alias("threshold")),
        F.struct(F.when(F.col("p95_seconds_per_row") > r["latency_p95_seconds_per_row"], "warning").alias("severity"),
                 F.lit("latency").alias("alert_type"), F.lit("p95_seconds_per_row").alias("subject"),
                 F.col("p95_seconds_per_row").alias("value"),
                 F.lit(float(r["latency_p95_seconds_per_row"])).alias("threshold")))).alias("a")).select("a.*")
    alerts = d.unionByName(lat).where(F.col("severity").isNotNull())
    # at most k pairs reach the driver (TakeOrderedAndProject)
    top = top_drift(drift, int(r["alert_top_drift_features"])).select("feature", "psi").collect()
    pairs = [F.struct(F.lit(t["feature"]).alias("feature"), F.lit(t["psi"]).alias("psi")) for t in top]
    return alerts.withColumn("top_drift_features", F.array(*pairs).cast("array<struct<feature:string,psi:double>>"))


def monitoring_report(drift: DataFrame, latency: DataFrame, alerts: DataFrame, counts: dict[str, int],
                      top: int = 20) -> DataFrame:
    """ALR-2: one nested row: ``drift_top`` (the ``top`` features by PSI), ``latency_summary``, ``alerts``, ``counts``.
    Every input is a small derived table (a row per feature or rule)."""
    ranked = rank_drift(drift).where(F.col("drift_rank") <= top)
    parts = [ranked.agg(F.array_sort(F.collect_list(F.struct("drift_rank", "feature", "psi", "ref_mean", "cur_mean"))).alias("drift_top")),
             latency.select(F.struct(*latency.columns).alias("latency_summary")),
             alerts.agg(F.array_sort(F.collect_list(F.struct("alert_type", "subject", "severity", "value", "threshold"))).alias("alerts"))]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    one = rows.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("drift_top", "latency_summary", "alerts")])
    return one.withColumn("counts", F.struct(*[F.lit(n).cast("long").alias(k) for k, n in counts.items()]))


def retrain_reasons(drift: DataFrame, alerts: DataFrame, latency: DataFrame, runs: DataFrame,
                    now_ts: str, triggers: dict | None = None) -> DataFrame:
    """RET-1: one row per fired trigger (reason, value).  ``runs`` has
    (run_id, last_ts) for training runs; ``now_ts`` is passed in."""
    t = dict(RETRAIN_TRIGGERS, **(triggers or {}))
    max_psi = drift.agg(F.coalesce(F.max("psi"), F.lit(0.0)).alias("value")) \
        .where(F.col("value") >= t["drift_psi_threshold"]).select(F.lit("drift_trigger").alias("reason"), "value")
    crit = alerts.where((F.lower("severity") == "critical") & (F.lower("alert_type") == "drift")) \
        .agg(F.count(F.lit(1)).cast("double").alias("value")) \
        .where(F.col("value") > t["max_critical_drift_features"]) \
        .select(F.lit("quality_gate_trigger").alias("reason"), "value")
    lat = latency.where(F.col("p95_total_seconds") >= t["latency_p95_seconds_threshold"]) \
        .select(F.lit("latency_trigger").alias("reason"), F.col("p95_total_seconds").alias("value"))
    days = (F.unix_micros(F.lit(now_ts).cast("timestamp"))
            - F.unix_micros(F.max("last_ts").cast("timestamp"))) / 86400e6
    per = runs.agg(F.count(F.lit(1)).alias("n"), days.alias("days")) \
        .where((F.col("n") == 0) | (F.col("days") >= t["max_days_since_last_train"])) \
        .select(F.when(F.col("n") == 0, "no_train_run_found").otherwise("periodic_trigger").alias("reason"),
                F.col("days").alias("value"))
    return max_psi.unionByName(crit).unionByName(lat).unionByName(per)


def critical_alerts(alerts: DataFrame) -> DataFrame:
    """FLT-6."""
    return alerts.where(F.lower("severity") == "critical")

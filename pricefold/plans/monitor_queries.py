"""Quality, drift, latency, alert, gate and registry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as DR
from ..operators import gates as G
from ..operators import monitoring as MON
from ..operators import quality as Q
from ..operators import registry as REG
from ..session import scratch_dir
from ..sources import catalog_io as IO
from ..operators import sliding as SL
from ..sources import tables as S
from .registry import query


def r6(c):
    return F.round(c, 6)


REQUIRED = ["sample_id", "catalog_content", "image_link", "price"]
BOUNDS = {"price": (905.0, 990.0)}
NOW = "2024-02-01 00:00:00"


@query("catalog_quality_issues", "DQ-1 FLT-3 MET-11 SET-2", oracle="""
WITH a AS (SELECT count(*) AS rows,
    avg(CASE WHEN sample_id IS NULL THEN 1.0 ELSE 0.0 END) AS nr_sample_id,
    avg(CASE WHEN catalog_content IS NULL THEN 1.0 ELSE 0.0 END) AS nr_catalog_content,
    avg(CASE WHEN image_link IS NULL THEN 1.0 ELSE 0.0 END) AS nr_image_link,
    avg(CASE WHEN price IS NULL OR isnan(price) THEN 1.0 ELSE 0.0 END) AS nr_price,
    CAST(count(*) FILTER (WHERE TRY_CAST(CAST(price AS VARCHAR) AS DOUBLE) < 905.0
                          OR TRY_CAST(CAST(price AS VARCHAR) AS DOUBLE) > 990.0) AS DOUBLE) AS ob_price
  FROM catalog),
r AS (SELECT rows, 'high_null_rate' AS issue_type, 'sample_id' AS column_name, nr_sample_id AS observed,
             NULL::DOUBLE AS limit_lo, 0.01::DOUBLE AS limit_hi, nr_sample_id > 0.01 AS hit FROM a
      UNION ALL SELECT rows, 'high_null_rate', 'catalog_content', nr_catalog_content, NULL, 0.01, nr_catalog_content > 0.01 FROM a
      UNION ALL SELECT rows, 'high_null_rate', 'image_link', nr_image_link, NULL, 0.01, nr_image_link > 0.01 FROM a
      UNION ALL SELECT rows, 'high_null_rate', 'price', nr_price, NULL, 0.01, nr_price > 0.01 FROM a
      UNION ALL SELECT rows, 'out_of_bounds', 'price', ob_price, 905.0::DOUBLE, 990.0::DOUBLE, ob_price > 0 FROM a),
p AS (SELECT *, CASE WHEN bool_or(hit AND issue_type IN ('missing_columns', 'out_of_bounds')) OVER () THEN 'reject'
                     WHEN bool_or(hit) OVER () THEN 'quarantine' ELSE 'allow' END AS policy FROM r)
SELECT rows, issue_type, column_name, round(observed, 6) AS observed, limit_lo, limit_hi, policy FROM p WHERE hit
""")
def catalog_quality_issues(spark, sf_dir):
    issues = Q.validate_batch_quality(S.catalog(spark, sf_dir), REQUIRED, max_null_rate=0.01, numeric_bounds=BOUNDS)
    return issues.withColumn("observed", r6(F.col("observed")))


@query("catalog_row_routes", "DQ-2", oracle="""
SELECT CASE WHEN TRY_CAST(CAST(price AS VARCHAR) AS DOUBLE) < 905.0 OR TRY_CAST(CAST(price AS VARCHAR) AS DOUBLE) > 990.0
            THEN 'reject'
            WHEN sample_id IS NULL OR catalog_content IS NULL OR image_link IS NULL OR price IS NULL OR isnan(price)
            THEN 'quarantine' ELSE 'allow' END AS dq_route,
       count(*) AS n_rows
FROM catalog GROUP BY 1
""")
def catalog_row_routes(spark, sf_dir):
    r = Q.route_rows(S.catalog(spark, sf_dir), REQUIRED, BOUNDS)
    return r.groupBy("dq_route").agg(F.count(F.lit(1)).alias("n_rows"))


@query("catalog_null_rates", "MET-11 FLT-4", oracle="""
SELECT 'sample_id' AS column_name, round(avg(CASE WHEN sample_id IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_rate FROM catalog
UNION ALL SELECT 'catalog_content', round(avg(CASE WHEN catalog_content IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM catalog
UNION ALL SELECT 'image_link', round(avg(CASE WHEN image_link IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM catalog
UNION ALL SELECT 'price', round(avg(CASE WHEN price IS NULL OR isnan(price) THEN 1.0 ELSE 0.0 END), 6) FROM catalog
""")
def catalog_null_rates(spark, sf_dir):
    return Q.null_rates(S.catalog(spark, sf_dir)).withColumn("null_rate", r6(F.col("null_rate")))


_DRIFT_DUCK = """
ref_l AS (SELECT 'value' AS feature, value AS x FROM drift_ref UNION ALL SELECT 'user_num', user_num FROM drift_ref
          UNION ALL SELECT 'trend', trend FROM drift_ref UNION ALL SELECT 'season', season FROM drift_ref),
cur_l AS (SELECT 'value' AS feature, value AS x FROM drift_cur UNION ALL SELECT 'user_num', user_num FROM drift_cur
          UNION ALL SELECT 'trend', trend FROM drift_cur UNION ALL SELECT 'season', season FROM drift_cur),
edges AS (SELECT feature, quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e
          FROM ref_l WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY feature),
rb AS (SELECT l.feature, len(list_filter(e, lambda v: l.x >= v)) AS bucket FROM ref_l l JOIN edges USING (feature)
       WHERE x IS NOT NULL AND NOT isnan(x)),
cb AS (SELECT l.feature, len(list_filter(e, lambda v: l.x >= v)) AS bucket FROM cur_l l JOIN edges USING (feature)
       WHERE x IS NOT NULL AND NOT isnan(x)),
rc AS (SELECT feature, bucket, count(*) AS ref_cnt FROM rb GROUP BY ALL),
cc AS (SELECT feature, bucket, count(*) AS cur_cnt FROM cb GROUP BY ALL),
rt AS (SELECT feature, count(*) AS ref_tot FROM rb GROUP BY ALL),
ct AS (SELECT feature, count(*) AS cur_tot FROM cb GROUP BY ALL),
j AS (SELECT coalesce(rc.feature, cc.feature) AS feature,
             greatest(coalesce(ref_cnt, 0) / greatest(ref_tot, 1), 1e-9) AS r,
             greatest(coalesce(cur_cnt, 0) / greatest(cur_tot, 1), 1e-9) AS c
      FROM rc FULL OUTER JOIN cc ON rc.feature = cc.feature AND rc.bucket = cc.bucket
      JOIN rt ON rt.feature = coalesce(rc.feature, cc.feature) JOIN ct ON ct.feature = coalesce(rc.feature, cc.feature)),
psi AS (SELECT feature, sum((c - r) * ln(c / r)) AS psi FROM j GROUP BY feature),
prof AS (SELECT 'ref' AS side, feature, avg(x) AS m, stddev_pop(x) AS s FROM ref_l GROUP BY ALL
         UNION ALL SELECT 'cur', feature, avg(x), stddev_pop(x) FROM cur_l GROUP BY ALL),
drift AS (SELECT psi.feature, psi.psi, pr.m AS ref_mean, pc.m AS cur_mean, pr.s AS ref_std, pc.s AS cur_std,
                 0.0::DOUBLE AS missing_ref, 0.0::DOUBLE AS missing_cur
          FROM psi JOIN prof pr ON pr.feature = psi.feature AND pr.side = 'ref'
          JOIN prof pc ON pc.feature = psi.feature AND pc.side = 'cur')
"""


def _drift(spark, sf_dir):
    ref = S.view(spark, sf_dir, "drift_ref")
    cur = S.view(spark, sf_dir, "drift_cur")
    # one row per feature; written once so alerts / triggers reuse it
    return DR.numeric_drift(ref, cur, DR.choose_numeric_features(ref)).checkpoint(eager=True)


@query("numeric_drift", "DRF-1 DRF-2 MET-12 MET-20 JOI-4 WIN-5", oracle=f"""
WITH {_DRIFT_DUCK}
SELECT feature, round(psi, 6) AS psi, round(ref_mean + 1e-8, 6) AS ref_mean, round(cur_mean + 1e-8, 6) AS cur_mean,
       round(ref_std, 6) AS ref_std, round(cur_std, 6) AS cur_std, missing_ref, missing_cur,
       row_number() OVER (ORDER BY psi DESC, feature) AS drift_rank
FROM drift
""")
def numeric_drift(spark, sf_dir):
    d = MON.rank_drift(_drift(spark, sf_dir))
    # a mean of two-digit values can lie exactly between two roundings: both sides step past it
    return d.select("feature", *[r6(F.col(c) + 1e-8).alias(c) for c in ["ref_mean", "cur_mean"]],
                    *[r6(F.col(c)).alias(c) for c in ["psi", "ref_std", "cur_std", "missing_ref", "missing_cur"]],
                    F.col("drift_rank").cast("long").alias("drift_rank"))


_LAT_DUCK = """
lat AS (SELECT count(*) AS runs,
        coalesce(quantile_cont(total_seconds, 0.5), 0) AS p50_total_seconds,
        coalesce(quantile_cont(total_seconds, 0.95), 0) AS p95_total_seconds,
        coalesce(quantile_cont(total_seconds, 0.99), 0) AS p99_total_seconds,
        coalesce(quantile_cont(seconds_per_row, 0.95), 0) AS p95_seconds_per_row FROM latency_events)
"""


@query("latency_summary", "MET-14 SRC-5", oracle=f"""
WITH {_LAT_DUCK}
SELECT runs, round(p50_total_seconds, 6) AS p50_total_seconds, round(p95_total_seconds, 6) AS p95_total_seconds,
       round(p99_total_seconds, 6) AS p99_total_seconds, round(p95_seconds_per_row, 6) AS p95_seconds_per_row FROM lat
""")
def latency_summary(spark, sf_dir):
    s = MON.latency_summary(S.view(spark, sf_dir, "latency_events"))
    return s.select("runs", *[r6(F.col(c)).alias(c) for c in s.columns if c != "runs"])


@query("service_metrics", "MET-15", oracle="""
SELECT service, count(*) AS requests, count(*) FILTER (WHERE is_error) AS errors, sum(rows_scored) AS predict_rows,
       round(count(*) FILTER (WHERE is_error) / greatest(count(*), 1), 6) AS error_rate,
       round(sum(image_fallback_rows) / greatest(sum(rows_scored), 1), 6) AS image_fallback_rate,
       round(sum(text_fallback_rows) / greatest(sum(rows_scored), 1), 6) AS text_fallback_rate,
       round(count(*) FILTER (WHERE dq_policy = 'allow') / greatest(count(dq_policy), 1), 6) AS dq_pass_rate,
       round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms,
       round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms
FROM service_requests GROUP BY service
""")
def service_metrics(spark, sf_dir):
    m = MON.service_metrics(S.request_events(spark, sf_dir), ["service"])
    return m.select("service", "requests", "errors", "predict_rows", *[r6(F.col(c)).alias(c) for c in [
        "error_rate", "image_fallback_rate", "text_fallback_rate", "dq_pass_rate", "p50_ms", "p95_ms", "p99_ms"]])


@query("rolling_latency_window", "WIN-1", oracle="""
WITH r AS (SELECT service, latency_ms, row_number() OVER (PARTITION BY service ORDER BY ts DESC, event_id DESC) AS rn
           FROM service_requests)
SELECT service, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms,
       round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms, 5000 AS window_rows
FROM r WHERE rn <= 5000 GROUP BY service
""")
def rolling_latency_window(spark, sf_dir):
    w = MON.rolling_latency_window(S.request_events(spark, sf_dir))
    return w.select("service", *[r6(F.col(c)).alias(c) for c in ["p50_ms", "p95_ms", "p99_ms"]], "window_rows")


@query("sliding_latency_percentiles", "WIN-1", oracle="""
SELECT service, event_id, row_number() OVER (PARTITION BY service ORDER BY ts, event_id) - 1 AS rank, count(latency_ms) OVER w AS window_rows,
       round(quantile_cont(latency_ms, 0.5) OVER w, 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95) OVER w, 6) AS p95_ms,
       round(quantile_cont(latency_ms, 0.99) OVER w, 6) AS p99_ms
FROM service_requests WHERE latency_ms IS NOT NULL
WINDOW w AS (PARTITION BY service ORDER BY ts, event_id ROWS BETWEEN 4999 PRECEDING AND CURRENT ROW)
""")
def sliding_latency_percentiles(spark, sf_dir):
    w = SL.sliding_percentiles(S.request_events(spark, sf_dir))
    return w.select("service", "event_id", "rank", "window_rows", *[r6(F.col(c)).alias(c) for c in ["p50_ms", "p95_ms", "p99_ms"]])


@query("monitoring_alerts", "ALR-1 ALR-2 TOP-2 FLT-6", oracle=f"""
WITH {_DRIFT_DUCK}, {_LAT_DUCK},
a AS (SELECT CASE WHEN psi >= 0.3 THEN 'critical' WHEN psi >= 0.2 THEN 'warning' END AS severity, 'drift' AS alert_type,
             feature AS subject, psi AS value, CASE WHEN psi >= 0.3 THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AS threshold FROM drift
      UNION ALL SELECT CASE WHEN p95_total_seconds > 5.0 THEN 'critical' END, 'latency', 'p95_total_seconds',
             p95_total_seconds, 5.0::DOUBLE FROM lat
      UNION ALL SELECT CASE WHEN p95_seconds_per_row > 0.05 THEN 'warning' END, 'latency', 'p95_seconds_per_row',
             p95_seconds_per_row, 0.05::DOUBLE FROM lat),
top AS (SELECT string_agg(feature || '=' || CAST(CAST(round(psi * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY psi DESC, feature)
               AS top_drift_features FROM (SELECT feature, psi FROM drift ORDER BY psi DESC, feature LIMIT 5))
SELECT severity, alert_type, subject, round(value, 6) AS value, threshold, top_drift_features
FROM a, top WHERE severity IS NOT NULL
""")
def monitoring_alerts(spark, sf_dir):
    d = _drift(spark, sf_dir)
    lat = MON.latency_summary(S.view(spark, sf_dir, "latency_events"))
    a = MON.evaluate_alerts(d, lat)
    pairs = F.transform("top_drift_features", lambda x: F.concat(   # PSI in millionths: no text form of doubles
        x["feature"], F.lit("="), F.round(x["psi"] * 1000000).cast("long").cast("string")))
    return a.withColumn("value", r6(F.col("value"))).withColumn("top_drift_features", F.array_join(pairs, ","))


@query("critical_alerts", "FLT-6", oracle=f"""
WITH {_DRIFT_DUCK}, {_LAT_DUCK}
SELECT 'drift' AS alert_type, feature AS subject FROM drift WHERE psi >= 0.3
UNION ALL SELECT 'latency', 'p95_total_seconds' FROM lat WHERE p95_total_seconds > 0.5
""")
def critical_alerts(spark, sf_dir):
    a = MON.evaluate_alerts(_drift(spark, sf_dir), MON.latency_summary(S.view(spark, sf_dir, "latency_events")),
                            {"latency_p95_total_seconds": 0.5})
    return MON.critical_alerts(a).select("alert_type", "subject")


@query("monitoring_report", "ALR-2 TOP-2 SNK-5", oracle=f"""
WITH {_DRIFT_DUCK}, {_LAT_DUCK}, top AS (SELECT *, row_number() OVER (ORDER BY psi DESC, feature) AS rk FROM drift)
SELECT 'drift_top' AS section, printf('%02d %s', rk, feature) AS name, round(psi, 6) AS value FROM top WHERE rk <= 20
UNION ALL SELECT 'latency_summary', 'runs', CAST(runs AS DOUBLE) FROM lat
UNION ALL SELECT 'latency_summary', 'p95_total_seconds', round(p95_total_seconds, 6) FROM lat
UNION ALL SELECT 'alerts', 'drift ' || feature || CASE WHEN psi >= 0.3 THEN ' critical' ELSE ' warning' END, round(psi, 6)
          FROM drift WHERE psi >= 0.2
UNION ALL SELECT 'alerts', 'latency p95_total_seconds critical', round(p95_total_seconds, 6) FROM lat WHERE p95_total_seconds > 5.0
UNION ALL SELECT 'alerts', 'latency p95_seconds_per_row warning', round(p95_seconds_per_row, 6) FROM lat WHERE p95_seconds_per_row > 0.05
UNION ALL SELECT 'counts', 'reference_rows', CAST(count(*) AS DOUBLE) FROM drift_ref
UNION ALL SELECT 'counts', 'current_rows', CAST(count(*) AS DOUBLE) FROM drift_cur
UNION ALL SELECT 'counts', 'latency_events', CAST(count(*) AS DOUBLE) FROM latency_events
""")
def monitoring_report(spark, sf_dir):
    """The nested report, written as JSON, read back and listed line by line."""
    d = _drift(spark, sf_dir)
    log = S.view(spark, sf_dir, "latency_events")
    lat = MON.latency_summary(log)
    counts = {"reference_rows": S.view(spark, sf_dir, "drift_ref").count(),
              "current_rows": S.view(spark, sf_dir, "drift_cur").count(), "latency_events": log.count()}
    report = MON.monitoring_report(d, lat, MON.evaluate_alerts(d, lat), counts)
    path = scratch_dir(spark, "monitoring-report")
    IO.write_json_report(report, path)
    back = spark.read.schema(report.schema).json(path)
    line = lambda section, name, value: F.struct(F.lit(section).alias("section"), name.alias("name"),     # noqa: E731
                                                 r6(value.cast("double")).alias("value"))
    parts = F.concat(
        F.transform("drift_top", lambda x: line("drift_top", F.format_string("%02d %s", x["drift_rank"], x["feature"]), x["psi"])),
        F.array(*[line("latency_summary", F.lit(c), F.col(f"latency_summary.{c}")) for c in ("runs", "p95_total_seconds")]),
        F.transform("alerts", lambda x: line("alerts", F.concat_ws(" ", x["alert_type"], x["subject"], x["severity"]), x["value"])),
        F.array(*[line("counts", F.lit(c), F.col(f"counts.{c}")) for c in counts]))
    return back.select(F.inline(parts))


_RUNS_DUCK = """
born AS (SELECT run_id, min(seq) AS born FROM run_events WHERE action = 'register' GROUP BY run_id),
ok AS (SELECT e.* FROM run_events e JOIN born USING (run_id) WHERE e.seq >= born),
act AS (SELECT run_id, seq, ts FROM ok WHERE action IN ('promote_production', 'activate', 'rollback')),
lst AS (SELECT run_id, arg_max(action, seq) AS action, max(seq) AS q FROM ok WHERE action <> 'register' GROUP BY run_id),
arch AS (SELECT l.run_id, min(a.seq) AS at_seq, arg_min(a.ts, a.seq) AS at_ts FROM lst l JOIN act a ON a.seq > l.q
         WHERE l.action IN ('promote_production', 'activate', 'rollback', 'approve_production') GROUP BY l.run_id),
reg AS (SELECT run_id, arg_min(stage, seq) AS first_stage, arg_max(stage, seq) AS stage FROM ok WHERE action = 'register' GROUP BY run_id),
bun AS (SELECT run_id, arg_max(bundle_path, seq) AS bundle_path FROM ok WHERE bundle_path IS NOT NULL GROUP BY run_id),
trk AS (SELECT run_id, arg_max(tracking_id, seq) AS tracking_id FROM ok WHERE tracking_id IS NOT NULL GROUP BY run_id),
own AS (SELECT run_id, min(ts) AS created_ts, max(seq) AS own_seq, arg_max(ts, seq) AS own_ts FROM ok GROUP BY run_id),
state AS (SELECT own.run_id,
     CASE WHEN l.action IS NULL THEN CASE WHEN first_stage = 'train' THEN 'staging' ELSE 'recorded' END
          WHEN l.action = 'promote_staging' THEN 'staging' WHEN l.action = 'promote_canary' THEN 'canary'
          WHEN arch.run_id IS NULL THEN 'production' ELSE 'archived' END AS status,
     coalesce(own.run_id = (SELECT arg_max(run_id, seq) FROM act), false) AS is_active, stage, bundle_path, tracking_id, created_ts,
     CASE WHEN at_seq > own_seq THEN at_seq ELSE own_seq END AS updated_seq,
     CASE WHEN at_seq > own_seq THEN at_ts ELSE own_ts END AS updated_ts
   FROM own JOIN reg USING (run_id) LEFT JOIN lst l USING (run_id) LEFT JOIN arch USING (run_id)
   LEFT JOIN bun USING (run_id) LEFT JOIN trk USING (run_id))
"""


def _runs(spark, sf_dir):
    """One row per run, written once: the lookups read it several times."""
    return REG.run_state(S.view(spark, sf_dir, "run_events")).checkpoint(eager=True)


@query("registry_state", "REG-1", oracle=f"""
WITH {_RUNS_DUCK} SELECT * FROM state
""")
def registry_state(spark, sf_dir):
    return REG.run_state(S.view(spark, sf_dir, "run_events"))


@query("registry_lookups", "REG-2 TOP-3 WIN-2 WIN-3", oracle=f"""
WITH {_RUNS_DUCK},
latest AS (SELECT run_id FROM state WHERE bundle_path IS NOT NULL ORDER BY updated_ts DESC, updated_seq DESC, run_id LIMIT 3),
train AS (SELECT run_id FROM state WHERE bundle_path IS NOT NULL AND stage = 'train' ORDER BY updated_ts DESC, updated_seq DESC, run_id LIMIT 1),
prev AS (SELECT run_id FROM state WHERE status IN ('production', 'archived') AND NOT is_active
         ORDER BY updated_ts DESC, updated_seq DESC, run_id LIMIT 1)
SELECT 'active' AS lookup, run_id FROM state WHERE is_active
UNION ALL SELECT 'latest', run_id FROM latest
UNION ALL SELECT 'latest_train', run_id FROM train
UNION ALL SELECT 'previous_production', run_id FROM prev
UNION ALL SELECT 'bundle:' || run_id, bundle_path FROM state WHERE bundle_path IS NOT NULL
UNION ALL SELECT 'status:' || status, CAST(count(*) AS VARCHAR) FROM state GROUP BY status
""")
def registry_lookups(spark, sf_dir):
    st = _runs(spark, sf_dir)
    named = lambda df, name: df.select(F.lit(name).alias("lookup"), "run_id")                  # noqa: E731
    bundles = st.where("bundle_path IS NOT NULL").select(F.concat(F.lit("bundle:"), "run_id").alias("lookup"),
                                                         F.col("bundle_path").alias("run_id"))
    counts = REG.status_counts(st).select(F.concat(F.lit("status:"), "status").alias("lookup"),
                                          F.col("runs").cast("string").alias("run_id"))
    return (named(st.where("is_active"), "active").unionByName(named(REG.latest_runs(st, 3), "latest"))
            .unionByName(named(REG.latest_runs(st, 1, stage="train"), "latest_train"))
            .unionByName(named(REG.previous_production(st), "previous_production")).unionByName(bundles).unionByName(counts))


@query("registry_resolved_ids", "JOI-7 REG-2", oracle=f"""
WITH {_RUNS_DUCK}, ids AS (SELECT DISTINCT run_id AS candidate FROM run_events
                           UNION SELECT DISTINCT tracking_id FROM run_events WHERE tracking_id IS NOT NULL
                           UNION SELECT 'nobody'),
b AS (SELECT * FROM state WHERE bundle_path IS NOT NULL)
SELECT candidate, coalesce(x.run_id, y.run_id) AS run_id
FROM ids LEFT JOIN b x ON x.run_id = candidate LEFT JOIN b y ON y.tracking_id = candidate
""")
def registry_resolved_ids(spark, sf_dir):
    ev = S.view(spark, sf_dir, "run_events")
    ids = ev.select(F.explode(F.array("run_id", "tracking_id", F.lit("nobody"))).alias("candidate")) \
            .where("candidate IS NOT NULL").distinct()
    return REG.resolve_run(_runs(spark, sf_dir), ids)


@query("registry_health", "MET-23", oracle=f"""
WITH {_RUNS_DUCK}, a AS (SELECT (SELECT count(*) FROM state) AS runs, (SELECT max(run_id) FROM state WHERE is_active) AS active_run_id,
     coalesce((SELECT bool_or(bundle_path IS NOT NULL) FROM state WHERE is_active), false) AS passed)
SELECT *, CASE WHEN passed THEN 'Registry OK: ' || runs || ' runs, active production=' ELSE
               'Registry incomplete: runs=' || runs || ', active_production=' END || coalesce(active_run_id, 'None') AS message FROM a
""")
def registry_health(spark, sf_dir):
    return REG.registry_health(_runs(spark, sf_dir))


@query("live_deployment_check", "REG-3", oracle=f"""
WITH {_RUNS_DUCK}, a AS (SELECT run_id AS active_run_id, bundle_path AS active_bundle FROM state WHERE is_active),
r AS (SELECT run_id AS subject, CASE WHEN q % 4 = 0 THEN NULL WHEN q % 4 = 1 THEN run_id ELSE active_run_id END AS m,
             CASE WHEN q % 5 = 0 THEN NULL WHEN q % 5 = 1 THEN run_id ELSE active_run_id END AS t,
             active_run_id AS act, coalesce(active_bundle, bundle_path) AS path
      FROM (SELECT *, updated_seq AS q FROM state), a),
e AS (SELECT subject, path, concat_ws(',', CASE WHEN m <> act THEN 'deployment_manifest_run_mismatch:' || m || '!=' || act END,
        CASE WHEN t <> act THEN 'production_tracker_run_mismatch:' || t || '!=' || act END,
        CASE WHEN m <> t THEN 'deployment_tracker_run_mismatch:' || m || '!=' || t END,
        CASE WHEN path IS NULL THEN 'missing_bundle_path' END) AS errors FROM r)
SELECT subject, path AS bundle_path, errors, errors = '' AS valid FROM e
""")
def live_deployment_check(spark, sf_dir):
    """Deployment records per run (some stale, some without a manifest or tracker) against the registry."""
    st = _runs(spark, sf_dir)
    active = st.where("is_active").select("run_id").first()[0]
    q = F.col("updated_seq")
    of = lambda n: F.when(q % n == 0, None).when(q % n == 1, F.col("run_id")).otherwise(F.lit(active))     # noqa: E731
    records = st.select(F.col("run_id").alias("subject"), of(4).alias("manifest_run_id"), F.col("bundle_path").alias("manifest_bundle"),
                        of(5).alias("tracker_run_id"), F.lit(None).cast("string").alias("tracker_bundle"))
    out = REG.live_deployment(records, st)
    return out.select("subject", "bundle_path", F.array_join("errors", ",").alias("errors"), "valid")


@query("retrain_triggers", "RET-1 DAT-1", oracle=f"""
WITH {_DRIFT_DUCK}, {_LAT_DUCK}, {_RUNS_DUCK},
crit AS (SELECT count(*) AS n FROM drift WHERE psi >= 0.3),
r AS (SELECT 'drift_trigger' AS reason, coalesce(max(psi), 0.0) AS value FROM drift HAVING coalesce(max(psi), 0.0) >= 0.3
      UNION ALL SELECT 'quality_gate_trigger', CAST(n AS DOUBLE) FROM crit WHERE n > 0
      UNION ALL SELECT 'latency_trigger', p95_total_seconds FROM lat WHERE p95_total_seconds >= 5.0
      UNION ALL SELECT CASE WHEN count(*) = 0 THEN 'no_train_run_found' ELSE 'periodic_trigger' END,
             (epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(max(updated_ts))) / 86400.0 FROM state
             HAVING count(*) = 0 OR (epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(max(updated_ts))) / 86400.0 >= 1)
SELECT reason, round(value, 6) AS value FROM r
""")
def retrain_triggers(spark, sf_dir):
    d = _drift(spark, sf_dir)
    lat = MON.latency_summary(S.view(spark, sf_dir, "latency_events"))
    alerts = MON.evaluate_alerts(d, lat)
    runs = REG.run_state(S.view(spark, sf_dir, "run_events")).select("run_id", F.col("updated_ts").alias("last_ts"))
    r = MON.retrain_reasons(d, alerts, lat, runs, NOW, {"max_days_since_last_train": 1})
    return r.withColumn("value", r6(F.col("value")))


_SLO_CTE = """
m AS (SELECT 'p_a' AS subject, 'smape' AS metric,
             avg(100.0 * abs(p_a - y) / greatest((abs(y) + abs(p_a)) / 2.0, 1e-8)) AS actual FROM predictions
      UNION ALL SELECT 'p_a', 'latency_p95', quantile_cont(latency_ms, 0.95) / 1000.0 FROM service_requests
      UNION ALL SELECT 'p_a', 'error_rate', count(*) FILTER (WHERE is_error) / greatest(count(*), 1) FROM service_requests
      UNION ALL SELECT 'p_b', 'smape', avg(100.0 * abs(p_b - y) / greatest((abs(y) + abs(p_b)) / 2.0, 1e-8)) FROM predictions
      UNION ALL SELECT 'p_b', 'latency_p95', 2.2 UNION ALL SELECT 'p_b', 'error_rate', 0.01 UNION ALL SELECT 'p_b', 'accuracy', 0.69),
s AS (SELECT DISTINCT subject FROM m),
t AS (SELECT * FROM (VALUES
  ('staging', 'accuracy', 0.65, '>='), ('staging', 'smape', 30.0, '<='), ('staging', 'latency_p95', 3.0, '<='), ('staging', 'error_rate', 0.05, '<='),
  ('canary', 'accuracy', 0.68, '>='), ('canary', 'smape', 35.0, '<='), ('canary', 'latency_p95', 2.5, '<='), ('canary', 'error_rate', 0.03, '<='),
  ('production', 'accuracy', 0.70, '>='), ('production', 'smape', 30.0, '<='), ('production', 'latency_p95', 2.0, '<='), ('production', 'error_rate', 0.02, '<=')
  ) v(stage, metric, threshold, direction))
"""


def _slo_metrics(spark, sf_dir):
    """p_a: measured, without accuracy; p_b: a canary's figures near the limits."""
    from ..operators import metrics as M
    p = S.predictions(spark, sf_dir)
    smape = [p.agg(F.avg(M.smape_term("y", c)).alias("actual")).select(F.lit(c).alias("subject"), F.lit("smape").alias("metric"), "actual")
             for c in ("p_a", "p_b")]
    svc = MON.service_metrics(S.request_events(spark, sf_dir))
    live = svc.select(F.inline(F.array(
        F.struct(F.lit("p_a").alias("subject"), F.lit("latency_p95").alias("metric"), (F.col("p95_ms") / 1000.0).alias("actual")),
        F.struct(F.lit("p_a").alias("subject"), F.lit("error_rate").alias("metric"), F.col("error_rate").alias("actual")))))
    told = spark.createDataFrame([("p_b", "latency_p95", 2.2), ("p_b", "error_rate", 0.01), ("p_b", "accuracy", 0.69)],
                                 "subject string, metric string, actual double")
    return smape[0].unionByName(smape[1]).unionByName(live).unionByName(told)


@query("slo_gates", "SLO-1 SLO-2", oracle=f"""
WITH {_SLO_CTE},
g AS (SELECT s.subject, t.stage, t.metric, m.actual,
             CASE WHEN m.actual IS NULL THEN true WHEN t.direction = '>=' THEN m.actual >= t.threshold ELSE m.actual <= t.threshold END AS passed
      FROM s CROSS JOIN t LEFT JOIN m ON m.subject = s.subject AND m.metric = t.metric)
SELECT subject, stage, bool_and(passed) AS passed,
       coalesce(string_agg(CASE WHEN NOT passed THEN metric END, ',' ORDER BY metric), '') AS failures,
       coalesce(string_agg(CASE WHEN actual IS NULL THEN metric END, ',' ORDER BY metric), '') AS absent_metrics,
       coalesce(bool_or(metric = 'error_rate' AND actual > 0.05), false) AS promotion_blocked
FROM g GROUP BY subject, stage
""")
def slo_gates(spark, sf_dir):
    checks = G.validate_metrics(_slo_metrics(spark, sf_dir))
    blocked = checks.groupBy("subject", "stage").agg(
        F.coalesce(F.bool_or((F.col("metric") == "error_rate") & (F.col("actual") > G.PROMOTION_MAX_ERROR_RATE)),
                   F.lit(False)).alias("promotion_blocked"))
    return G.gate_summary(checks).join(blocked, ["subject", "stage"])


_GATED = """SELECT subject, stage, metric, round(actual, 6) AS actual, threshold, passed FROM g"""


@query("canary_monitor", "SLO-4", oracle=f"""
WITH {_SLO_CTE}, c AS (SELECT * FROM (VALUES ('latency_p95', 2.0::DOUBLE), ('error_rate', 0.03::DOUBLE)) v(metric, threshold)),
g AS (SELECT s.subject, 'canary' AS stage, c.metric, m.actual, c.threshold, coalesce(m.actual <= c.threshold, false) AS passed
      FROM s CROSS JOIN c LEFT JOIN m ON m.subject = s.subject AND m.metric = c.metric)
{_GATED}
""")
def canary_monitor(spark, sf_dir):
    """Latency and error rate only (accuracy and SMAPE may be absent), with a tighter latency limit given."""
    out = G.canary_monitor(_slo_metrics(spark, sf_dir), {"max_latency_p95": 2.0})
    return out.withColumn("actual", r6(F.col("actual")))


@query("production_gate", "SLO-5 SLO-2", oracle=f"""
WITH {_SLO_CTE}, o AS (SELECT * FROM (VALUES ('accuracy', 0.6, '>='), ('error_rate', 0.5, '<=')) v(metric, threshold, direction)),
g AS (SELECT s.subject, t.stage, t.metric, m.actual, CAST(t.threshold AS DOUBLE) AS threshold,
             CASE WHEN m.actual IS NULL THEN true WHEN t.direction = '>=' THEN m.actual >= t.threshold ELSE m.actual <= t.threshold END AS passed
      FROM s CROSS JOIN t LEFT JOIN m ON m.subject = s.subject AND m.metric = t.metric WHERE t.stage = 'production'
      UNION ALL SELECT s.subject, 'production', o.metric || '_override', m.actual, CAST(o.threshold AS DOUBLE),
             CASE WHEN m.actual IS NULL THEN false WHEN o.direction = '>=' THEN m.actual >= o.threshold ELSE m.actual <= o.threshold END
      FROM s CROSS JOIN o LEFT JOIN m ON m.subject = s.subject AND m.metric = o.metric)
{_GATED}
""")
def production_gate(spark, sf_dir):
    """Production limits plus overrides; an overridden metric that is absent (p_a's accuracy) fails."""
    out = G.production_gate(_slo_metrics(spark, sf_dir), {"min_accuracy": 0.6, "max_error_rate": 0.5})
    return out.withColumn("actual", r6(F.col("actual")))


@query("slo_metrics_from_payload", "MET-17 JSN-1", oracle="""
WITH d AS (SELECT event_id % 6 AS form, event_id AS subject, value, 1 + event_id % 50 AS n FROM events)
SELECT subject, 'latency_p95' AS metric, round(CASE WHEN form = 0 THEN value / 1000.0 ELSE value END, 6) AS actual FROM d WHERE form IN (0, 1, 2)
UNION ALL SELECT subject, 'error_rate', round(3.0 / n, 6) FROM d WHERE form = 0
UNION ALL SELECT subject, 'error_rate', 0.25 FROM d WHERE form = 1
UNION ALL SELECT subject, 'accuracy', 0.5 FROM d WHERE form IN (1, 2)
UNION ALL SELECT subject, 'error_rate', 2.0 FROM d WHERE form = 3
UNION ALL SELECT subject, 'smape', 12.5 FROM d WHERE form = 4
""")
def slo_metrics_from_payload(spark, sf_dir):
    """A JSON payload per event in six forms: milliseconds and counts, direct figures at the top, the same under
    ``metrics``, no requests, text figures, and one that is no JSON."""
    v, n, form = F.col("value").cast("string"), (1 + F.col("event_id") % 50).cast("string"), F.col("event_id") % 6
    body = (F.when(form == 0, F.concat(F.lit('{"latency_ms": {"p95": '), v, F.lit('}, "request_count": '), n, F.lit(', "error_count": 3}')))
            .when(form == 1, F.concat(F.lit('{"metrics": 7, "latency_p95": '), v, F.lit(', "error_rate": 0.25, "accuracy": 0.5, "error_count": 9, "request_count": 9}')))
            .when(form == 2, F.concat(F.lit('{"error_rate": 1, "metrics": {"latency_p95": "'), v, F.lit('", "accuracy": 0.5, "smape": "none"}}')))
            .when(form == 3, F.lit('{"request_count": 0, "error_count": 2, "latency_ms": 5}'))
            .when(form == 4, F.lit('{"smape": "12.5", "error_count": 4, "latency_ms": {}}')).otherwise(F.lit("not json")))
    ev = S.table(spark, sf_dir, "events").select(F.col("event_id").alias("subject"), body.alias("body"))
    return G.extract_slo_metrics(ev).withColumn("actual", r6(F.col("actual")))

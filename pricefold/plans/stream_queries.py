"""Streaming queries: each runs a Structured Streaming job to completion
(``availableNow``) over the shared tables' own files, then returns the sink table.  Where an oracle exists it is the batch SQL twin, so these checks
assert stream result == batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ranking import exact_percentiles
from ..sources import tables as S
from ..streaming import jobs as J
from ..streaming import rolling as R
from .registry import query


def r6(c):
    return F.round(c, 6)


def _fmt(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# append mode writes a window once the watermark (10 minutes behind the newest event) has passed its end
_CLOSED = "{end} <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)"


@query("stream_tumbling_event_stats", "STR-1", oracle=f"""
WITH w AS (SELECT time_bucket(INTERVAL '1 day', ts) AS ws, event_type, value FROM events)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total_value,
       max(value) AS max_value, quantile_disc(value, 0.5) AS p50_value, quantile_disc(value, 0.95) AS p95_value
FROM w WHERE {_CLOSED.format(end="ws + INTERVAL '1 day'")} GROUP BY ws, event_type
""")
def stream_tumbling_event_stats(spark, sf_dir):
    path, _ = J.run_to_table(J.tumbling_stats(J.event_stream(spark, sf_dir)), "tumbling")
    out = spark.read.parquet(path)
    return out.select(_fmt("window_start").alias("window_start"), "event_type", "n",
                      r6(F.col("total_value")).alias("total_value"), "max_value", "p50_value", "p95_value")


@query("stream_sliding_service_metrics", "STR-2 MET-15", oracle=f"""
WITH w AS (SELECT unnest([time_bucket(INTERVAL '12 hours', ts), time_bucket(INTERVAL '12 hours', ts) - INTERVAL '12 hours'])
                  AS ws, * FROM service_requests)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, service, count(*) AS requests,
       count(*) FILTER (WHERE is_error) AS errors, round(count(*) FILTER (WHERE is_error) / greatest(count(*), 1), 6) AS error_rate,
       round(sum(image_fallback_rows) / greatest(sum(rows_scored), 1), 6) AS image_fallback_rate,
       round(sum(text_fallback_rows) / greatest(sum(rows_scored), 1), 6) AS text_fallback_rate,
       round(count(*) FILTER (WHERE dq_policy = 'allow') / greatest(count(dq_policy), 1), 6) AS dq_pass_rate
FROM w WHERE {_CLOSED.format(end="ws + INTERVAL '1 day'")} GROUP BY ws, service
""")
def stream_sliding_service_metrics(spark, sf_dir):
    requests = spark.sql(S.VIEWS["service_requests"], events=J.event_stream(spark, sf_dir))
    path, _ = J.run_to_table(J.sliding_service_metrics(requests), "sliding")
    out = spark.read.parquet(path)
    return out.select(_fmt("window_start").alias("window_start"), "service", "requests", "errors", *[
        r6(F.col(c)).alias(c) for c in ("error_rate", "image_fallback_rate", "text_fallback_rate", "dq_pass_rate")])


@query("stream_rolling_latency", "STR-2 WIN-1", oracle="""
WITH r AS (SELECT service, latency_ms, row_number() OVER (PARTITION BY service ORDER BY ts DESC, event_id DESC) AS rn
           FROM service_requests)
SELECT service, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms,
       round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms, 5000 AS window_rows
FROM r WHERE rn <= 5000 GROUP BY service
""")
def stream_rolling_latency(spark, sf_dir):
    """The latency buffers held as stream state, after the last micro-batch."""
    requests = spark.sql(S.VIEWS["service_requests"], events=J.event_stream(spark, sf_dir))
    path, _ = R.run_latency_buffers(requests)
    w = R.rolling_percentiles(spark, path)
    return w.select("service", *[r6(F.col(c)).alias(c) for c in ["p50_ms", "p95_ms", "p99_ms"]], "window_rows")


_DQ_REQUIRED = ["sample_id", "catalog_content", "image_link", "price"]


@query("stream_dq_routes", "STR-3 DQ-1 DQ-2 SNK-4", oracle="""
WITH t AS (SELECT CASE WHEN price < 905.0 OR price > 990.0 THEN 'reject' WHEN catalog_content IS NULL THEN 'quarantine' ELSE 'allow' END AS strict,
                  CASE WHEN catalog_content IS NULL THEN 'quarantine' ELSE 'allow' END AS loose FROM catalog)
SELECT 'bounds' AS rules, 'reject' AS policy, 'rejected' AS target, strict AS dq_route, count(*) AS n_rows FROM t GROUP BY strict
UNION ALL SELECT 'null_rate', 'quarantine', unnest(['scoring', 'quarantine']), loose, count(*) FROM t GROUP BY loose
UNION ALL SELECT 'none', 'allow', 'scoring', loose, count(*) FROM t GROUP BY loose
""")
def stream_dq_routes(spark, sf_dir):
    """The catalog as a stream under rules that reject, quarantine and allow its batch."""
    parts = []
    for rules, bounds, rate in (("bounds", {"price": (905.0, 990.0)}, 0.5), ("null_rate", {}, 0.001), ("none", {}, 0.5)):
        cat = spark.sql(S.VIEWS["catalog"], part=J.table_stream(spark, sf_dir, "part"))
        base, _ = J.run_to_table(cat, f"dq-{rules}", J.quality_sink(_DQ_REQUIRED, bounds, rate))
        parts.append(spark.read.parquet(base).groupBy("policy", "target", "dq_route").agg(F.count(F.lit(1)).alias("n_rows"))
                     .select(F.lit(rules).alias("rules"), "policy", "target", "dq_route", "n_rows"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_DRIFT_STREAM_DUCK = """
WITH ref_l AS (SELECT 'value' AS feature, value AS x FROM drift_ref UNION ALL SELECT 'user_num', user_num FROM drift_ref),
edges AS (SELECT feature, quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e
          FROM ref_l WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY feature),
rb AS (SELECT l.feature, len(list_filter(e, lambda v: l.x >= v)) AS bucket FROM ref_l l JOIN edges USING (feature)
       WHERE x IS NOT NULL),
rt AS (SELECT feature, count(*) AS t FROM rb GROUP BY feature),
grid AS (SELECT feature, t, unnest(range(0, 10)) AS bucket FROM rt),
rs AS (SELECT g.feature, g.bucket, coalesce(c.c, 0) / g.t AS ref_share
       FROM grid g LEFT JOIN (SELECT feature, bucket, count(*) AS c FROM rb GROUP BY ALL) c USING (feature, bucket)),
cur_l AS (SELECT time_bucket(INTERVAL '1 day', ts) AS ws, 'value' AS feature, value AS x FROM events
          WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'
          UNION ALL SELECT time_bucket(INTERVAL '1 day', ts), 'user_num', CAST(user_id AS DOUBLE) FROM events
          WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'),
cb AS (SELECT ws, l.feature, len(list_filter(e, lambda v: l.x >= v)) AS bucket FROM cur_l l JOIN edges USING (feature)
       WHERE x IS NOT NULL AND NOT isnan(x)),
snap AS (SELECT ws, feature, bucket, count(*) AS cnt FROM cb
         WHERE ws + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events) GROUP BY ALL),
tot AS (SELECT ws, feature, sum(cnt) AS tot FROM snap GROUP BY ALL),
j AS (SELECT t.ws, t.feature, greatest(coalesce(s.cnt, 0) / t.tot, 1e-9) AS c, greatest(rs.ref_share, 1e-9) AS r
      FROM tot t JOIN rs ON rs.feature = t.feature
      LEFT JOIN snap s ON s.ws = t.ws AND s.feature = t.feature AND s.bucket = rs.bucket),
psi AS (SELECT ws, feature, sum((c - r) * ln(c / r)) AS psi FROM j GROUP BY ALL)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, feature, round(psi, 6) AS psi,
       CASE WHEN psi >= 0.3 THEN 'critical' WHEN psi >= 0.2 THEN 'warning' END AS severity
FROM psi
"""


@query("stream_drift_alerts", "STR-4 STR-5", oracle=_DRIFT_STREAM_DUCK)
def stream_drift_alerts(spark, sf_dir):
    feats = ["value", "user_num"]
    ref = S.view(spark, sf_dir, "drift_ref")
    ref_long = ref.select(*feats).unpivot([], feats, "feature", "x").where(F.col("x").isNotNull())
    edges = (exact_percentiles(ref_long, "x", [i / 10 for i in range(1, 10)], ["feature"])
             .groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("prob", "value"))),
                                                 lambda s: s["value"]).alias("edges")))
    rb = ref_long.join(F.broadcast(edges), "feature") \
                 .withColumn("bucket", F.size(F.filter("edges", lambda e: F.col("x") >= e)))
    buckets = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("bucket")
    counts = rb.groupBy("feature", "bucket").agg(F.count(F.lit(1)).alias("c"))
    tot = rb.groupBy("feature").agg(F.count(F.lit(1)).alias("t"))
    grid = tot.select("feature", "t", buckets)
    ref_shares = grid.join(counts, ["feature", "bucket"], "left") \
                     .select("feature", "bucket", (F.coalesce(F.col("c"), F.lit(0)) / F.col("t")).alias("ref_share"))
    cur = J.event_stream(spark, sf_dir).where(F.col("ts") >= F.lit("2024-01-16 00:00:00").cast("timestamp")) \
        .select("ts", "value", F.col("user_id").cast("double").alias("user_num"))
    path, _ = J.run_to_table(J.drift_snapshots(cur, edges, feats), "drift", J.alert_sink(ref_shares))
    out = spark.read.parquet(path)
    psi = out.where("part = 'psi'").select("window_start", "feature", "psi")
    alerts = out.where("part = 'alerts'").select("window_start", "feature", "severity")
    # every snapshot with its alert, if the stream wrote one
    return psi.join(alerts, ["window_start", "feature"], "left").select(
        _fmt("window_start").alias("window_start"), "feature", r6(F.col("psi")).alias("psi"), "severity")


@query("stream_scoring", "STR-6 SPL-4 PRD-1", oracle="""
WITH m AS (SELECT regr_slope(p_retailprice, CAST(p_size AS DOUBLE)) AS a,
                  regr_intercept(p_retailprice, CAST(p_size AS DOUBLE)) AS b FROM part)
SELECT p_partkey, round(a * p_size + b, 4) AS prediction,
       CASE WHEN CAST(('0x' || substr(md5(CAST(p_partkey AS VARCHAR) || ':7'), 1, 8)) AS BIGINT) % 10000 < 1000
            THEN 'canary' ELSE 'primary' END AS route
FROM part, m
""")
def stream_scoring(spark, sf_dir):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from ..operators.models import linear
    part = S.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"),
                                                  F.col("p_retailprice").alias("label"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), linear()]).fit(part)
    stream = J.table_stream(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"))
    scored = J.score_stream(stream, model, "p_partkey", 10.0)
    out_path, _ = J.run_to_table(scored.select("p_partkey", "prediction", "route"), "scoring")
    out = spark.read.parquet(out_path)
    return out.select("p_partkey", F.round("prediction", 4).alias("prediction"), "route")


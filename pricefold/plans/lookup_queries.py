"""Lookup joins, baselines, registry history, column resolution and first-n
queries (JOI-5, JOI-6, MET-16, MET-22, DRF-3, REG-4, SCH-2, TOP-4, TXT-10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.units import QUANTITY_UNIT_RULES
from ..operators import drift as DR
from ..session import scratch_dir
from ..sources import catalog_io as IO
from ..sources import tables as S
from . import duck as D
from .registry import query


def r6(c):
    return F.round(c, 6)


@query("quantity_unit_lookup", "JOI-5 MET-22 TXT-5 TXT-6", oracle=f"""
WITH q AS (SELECT unnest({D.quantities('catalog_content')}) AS m FROM catalog),
u AS (SELECT m.unit AS unit, m.value AS value FROM q)
SELECT unit, {D.bucket_name('unit')} AS bucket, count(*) AS mentions,
       round(sum(value * {D.bucket_scale_any('unit')}), 6) AS normalised_total
FROM u GROUP BY ALL
""")
def quantity_unit_lookup(spark, sf_dir):
    """Quantity mentions exploded and joined to the unit-rule table (36 rows,
    a fixed size, so the broadcast is bounded); unknown units keep a null bucket."""
    rules = spark.createDataFrame([(u, b, float(s)) for u, (b, s) in QUANTITY_UNIT_RULES.items()],
                                  "unit string, bucket string, scale double")
    q = S.catalog(spark, sf_dir).select(F.explode(T.quantities(F.col("catalog_content"))).alias("m"))
    m = q.select(F.col("m.unit").alias("unit"), F.col("m.value").alias("value"))
    j = m.join(F.broadcast(rules), "unit", "left")
    return j.groupBy("unit", "bucket").agg(
        F.count(F.lit(1)).alias("mentions"),
        r6(F.sum(F.col("value") * F.coalesce(F.col("scale"), F.lit(0.0)))).alias("normalised_total"))


@query("external_metadata_merge", "JOI-6", oracle="""
WITH meta AS (SELECT l_partkey AS unique_identifier, count(*) AS n_sales, sum(l_extendedprice) AS total_sale
              FROM lineitem GROUP BY l_partkey)
SELECT c.sample_id, coalesce(m.n_sales, 0) AS n_sales, round(m.total_sale, 2) AS total_sale
FROM catalog c LEFT JOIN meta m ON c.sample_id = m.unique_identifier
""")
def external_metadata_merge(spark, sf_dir):
    """Left join of the catalog to a metadata table keyed on the item id; AQE picks the join from measured sizes."""
    meta = S.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("sample_id")) \
        .agg(F.count(F.lit(1)).alias("n_sales"), F.sum("l_extendedprice").alias("total_sale"))
    j = S.catalog(spark, sf_dir).select("sample_id").join(meta, "sample_id", "left")
    return j.select("sample_id", F.coalesce(F.col("n_sales"), F.lit(0)).alias("n_sales"),
                    F.round(F.col("total_sale"), 2).alias("total_sale"))


@query("smoke_inference_metrics", "MET-16", oracle="""
SELECT count(*) AS rows_scored, round(avg(p_a), 6) AS mean_prediction,
       round(avg(p_a) FILTER (WHERE p_a > 0), 6) AS mean_positive_prediction,
       count(*) FILTER (WHERE p_a IS NULL OR isnan(p_a)) AS missing_predictions,
       round(any_value(l.total_seconds), 6) AS total_seconds,
       round(any_value(l.total_seconds) * 1000 / greatest(any_value(l.logged_rows), 1), 6) AS latency_ms_per_row,
       round(any_value(l.logged_rows) / any_value(l.total_seconds), 6) AS throughput_rows_per_second
FROM predictions, (SELECT sum(total_seconds) AS total_seconds, sum(rows_scored) AS logged_rows FROM latency_events) l
""")
def smoke_inference_metrics(spark, sf_dir):
    """Prediction summary of a scored batch, with throughput and latency per row from the latency log of its runs."""
    p = S.predictions(spark, sf_dir)
    one = p.agg(F.count(F.lit(1)).alias("rows_scored"), r6(F.avg("p_a")).alias("mean_prediction"),
                r6(F.avg(F.when(F.col("p_a") > 0, F.col("p_a")))).alias("mean_positive_prediction"),
                F.count_if(F.col("p_a").isNull() | F.isnan("p_a")).alias("missing_predictions"))
    log = S.view(spark, sf_dir, "latency_events").agg(F.sum("total_seconds").alias("s"), F.sum("rows_scored").alias("n")).first()
    s, n = float(log["s"] or 0.0), float(log["n"] or 0.0)
    return one.select("*", r6(F.lit(s)).alias("total_seconds"), r6(F.lit(s * 1000 / max(n, 1.0))).alias("latency_ms_per_row"),
                      r6(F.lit(n / s if s else None).cast("double")).alias("throughput_rows_per_second"))


@query("baseline_drift_stats", "DRF-3", oracle="""
WITH b AS (SELECT avg(value) AS numeric_mean, stddev_pop(value) AS numeric_std, avg(length(props)) AS text_length_mean
           FROM events WHERE ts < TIMESTAMP '2024-01-16 00:00:00'),
c AS (SELECT avg(value) AS numeric_mean, stddev_pop(value) AS numeric_std, avg(length(props)) AS text_length_mean
      FROM events WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'),
l AS (SELECT 'numeric_mean' AS stat, c.numeric_mean AS cur, b.numeric_mean AS base FROM b, c
      UNION ALL SELECT 'numeric_std', c.numeric_std, b.numeric_std FROM b, c
      UNION ALL SELECT 'text_length_mean', c.text_length_mean, b.text_length_mean FROM b, c),
p AS (SELECT stat, abs(cur - base) / (base + 1e-6) AS pct FROM l)
SELECT stat, round(pct, 6) AS pct_change, pct > 0.05 AS drifted, round(max(pct) OVER (), 6) AS drift_score,
       max(pct) OVER () > 0.01 AS alarm FROM p
""")
def baseline_drift_stats(spark, sf_dir):
    ev = S.table(spark, sf_dir, "events")
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    stats = {"numeric_mean": F.avg("value"), "numeric_std": F.stddev_pop("value"),
             "text_length_mean": F.avg(F.length("props"))}
    base_row = ev.where(F.col("ts") < cut).agg(*[e.alias(k) for k, e in stats.items()]).first()
    out = DR.baseline_drift(ev.where(F.col("ts") >= cut), base_row.asDict(), stats, threshold=0.01)
    return out.select("stat", r6(F.col("pct_change")).alias("pct_change"), "drifted",
                      r6(F.col("drift_score")).alias("drift_score"), "alarm")


@query("registry_history_log", "REG-4 SNK-2", oracle="""
SELECT action, count(*) AS n_records FROM run_events WHERE action IN ('activate', 'rollback', 'promote_canary')
GROUP BY action
""")
def registry_history_log(spark, sf_dir):
    """Promotion / rollback history appended as JSON lines, read back."""
    ev = S.view(spark, sf_dir, "run_events").where(F.col("action").isin("activate", "rollback", "promote_canary"))
    path = scratch_dir(spark, "promotion-history")
    IO.append_jsonl(ev.select("run_id", F.col("action"), F.col("seq")), path)
    back = spark.read.schema("run_id string, action string, seq long, ts_utc timestamp").json(path)
    return back.groupBy("action").agg(F.count(F.lit(1)).alias("n_records"))


@query("resolved_column_names", "SCH-2 SCH-1", oracle="""
SELECT sample_id, length(coalesce(catalog_content, '')) AS catalog_content_clean_len, price FROM catalog
""")
def resolved_column_names(spark, sf_dir):
    """A table carrying alias names (and a derived alias column) is read with
    canonical names resolved on ``df.columns``."""
    cat = S.catalog(spark, sf_dir).withColumnsRenamed(
        {"sample_id": "unique_identifier", "catalog_content": "Description", "price": "Price"})
    cat = cat.withColumn("Description_clean_len", F.length(T.text_or_empty(F.col("Description"))))
    want = ["sample_id", "catalog_content_clean_len", "price"]
    out = cat.select(*[F.col(IO.resolve_column_name(cat.columns, w)).alias(w) for w in want])
    return out.withColumn("catalog_content_clean_len", F.col("catalog_content_clean_len").cast("long"))


@query("first_rows_by_id", "TOP-4", oracle="""
SELECT sample_id, price FROM catalog ORDER BY sample_id LIMIT 32
""")
def first_rows_by_id(spark, sf_dir):
    """First n rows in id order (Spark has no row order; the order is explicit)."""
    return S.catalog(spark, sf_dir).select("sample_id", "price").orderBy("sample_id").limit(32)


@query("catalog_fields_multiline", "TXT-10")
def catalog_fields_multiline(spark, sf_dir):
    """Multi-line field extraction; lookahead patterns have no DuckDB twin, so
    tests compare it with a plain-Python rendering of the rule on a fixture."""
    c = T.extract_catalog_fields(S.catalog(spark, sf_dir).select("sample_id", "catalog_content"))
    f = F.col("fields")
    return c.select("sample_id", f["item_name"].alias("item_name"),
                    F.array_join(f["bullet_points"], " | ").alias("bullets"),
                    f["product_description"].alias("product_description"),
                    f["value"].alias("value"), f["unit"].alias("unit"))

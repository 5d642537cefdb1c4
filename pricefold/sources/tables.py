"""Shared input tables and the fixture views defined over them.

Every view is one SQL text with ``{table}`` placeholders.  Spark binds the
placeholders to DataFrames (``spark.sql(text, part=df)``), so no global temp
view names are shared between scale factors; the DuckDB oracle formats the same
text with plain table names.  Reads are lazy parquet scans, so Catalyst prunes
columns and pushes filters into each scan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_utc(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_utc(spark: SparkSession) -> None:
    """The event, run and latency timestamps are UTC wall-clock values; window
    starts, watermarks and run ids are computed in a UTC session."""
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


# Fixed view texts (they run unchanged in Spark SQL and DuckDB).
CATALOG_SQL = """
SELECT p_partkey AS sample_id,
 CASE WHEN p_partkey % 50 = 49 THEN NULL
      WHEN p_partkey % 50 = 48 THEN concat(p_name, ' plain text')
 ELSE concat('Item Name: ', p_name, ', ', CAST(p_size AS STRING), ' ', unit, ' by ', p_brand,
   ' (Pack of ', CAST(1 + p_partkey % 6 AS STRING), ')', chr(10),
   'Bullet Point 1: ', p_type, ' grade, ', CAST(p_size AS STRING), '.5 ml each', chr(10),
   'Bullet Point 2: ', CAST(2 + p_partkey % 9 AS STRING), ' count', chr(10),
   'Product Description: Made of <b>', p_name, '</b> for daily use', chr(10),
   'Value: ', CAST(p_size AS STRING), '.0', chr(10), 'Unit: ', unit, chr(10)) END AS catalog_content,
 CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat('https://img.example.com/', CAST(p_partkey AS STRING), '.jpg') END AS image_link,
 p_retailprice AS price
FROM (SELECT *, CASE p_partkey % 8 WHEN 0 THEN 'oz' WHEN 1 THEN 'Fl Oz' WHEN 2 THEN 'lb' WHEN 3 THEN 'g'
      WHEN 4 THEN 'Count' WHEN 5 THEN 'kg' WHEN 6 THEN 'ml' ELSE 'Ounce' END AS unit FROM {part}) p
"""

PREDICTIONS_SQL = """
SELECT o_orderkey AS sample_id, o_totalprice AS y,
       o_totalprice * (1.0 - CAST(o_orderkey % 11 AS DOUBLE) / 100) AS p_a,
       o_totalprice * (1.0 + CAST(o_orderkey % 7 AS DOUBLE) / 100) AS p_b,
       CAST(1000 + o_custkey % 5000 AS DOUBLE) AS p_c
FROM {orders}
"""

# value and user_num keep their distribution; trend drifts to a warning, season to a critical PSI
_DRIFT_COLS = ("value, CAST(user_id AS DOUBLE) AS user_num, value + 0.4 * extract(day FROM ts) AS trend, "
               "value + 0.7 * extract(day FROM ts) AS season")
DRIFT_REF_SQL = f"SELECT {_DRIFT_COLS} FROM {{events}} WHERE ts <  TIMESTAMP '2024-01-16 00:00:00'"
DRIFT_CUR_SQL = f"SELECT {_DRIFT_COLS} FROM {{events}} WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'"

LATENCY_EVENTS_SQL = """
SELECT concat('run_', CAST(user_id AS STRING)) AS run_id, 1 + event_id % 50 AS rows_scored,
       value / 100 AS total_seconds, value / 100 * 0.8 AS predict_seconds,
       value / 100 / (1 + event_id % 50) AS seconds_per_row, ts AS ts_utc, event_id
FROM {events}
"""

RUN_EVENTS_SQL = """
SELECT event_id AS seq, concat('train_', CAST(user_id AS STRING)) AS run_id,
       CASE event_type WHEN 'signup' THEN 'register' WHEN 'view' THEN 'promote_staging' WHEN 'click' THEN 'promote_canary'
            WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'promote_production' WHEN event_id % 3 = 1 THEN 'activate'
                                      ELSE 'approve_production' END
            ELSE CASE WHEN event_id % 5 = 0 THEN 'rollback' ELSE 'promote_canary' END END AS action, ts,
       CASE WHEN event_type = 'signup' THEN CASE WHEN user_id % 6 = 5 THEN 'promotion' ELSE 'train' END END AS stage,
       CASE WHEN event_type = 'signup' AND event_id % 4 <> 0 AND user_id % 6 <> 5
            THEN concat('runs/train_', CAST(user_id AS STRING), '/bundle') END AS bundle_path,
       CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN concat('track_', CAST(user_id AS STRING)) END AS tracking_id
FROM {events}
"""

SERVICE_REQUESTS_SQL = """
SELECT event_id, ts, event_type AS service, event_type = 'error' AS is_error, value AS latency_ms,
       1 + event_id % 50 AS rows_scored,
       CASE WHEN event_id % 7 = 0 THEN 1 + event_id % 50 ELSE 0 END AS image_fallback_rows,
       CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS text_fallback_rows,
       CASE WHEN event_id % 20 = 0 THEN 'reject' WHEN event_id % 20 < 3 THEN 'quarantine' ELSE 'allow' END AS dq_policy
FROM {events}
"""

VIEWS = {
    "catalog": CATALOG_SQL,
    "predictions": PREDICTIONS_SQL,
    "drift_ref": DRIFT_REF_SQL,
    "drift_cur": DRIFT_CUR_SQL,
    "latency_events": LATENCY_EVENTS_SQL,
    "run_events": RUN_EVENTS_SQL,
    "service_requests": SERVICE_REQUESTS_SQL,
}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def view_sql_for_duckdb(name: str) -> str:
    """The view text with plain table names (for the DuckDB oracle)."""
    return _PLACEHOLDER.sub(lambda m: m.group(1), VIEWS[name])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    refs = {t: table(spark, sf_dir, t) for t in set(_PLACEHOLDER.findall(text))}
    return spark.sql(text, **refs)


def spread(df: DataFrame) -> DataFrame:
    """The same rows over as many tasks as the cluster has cores: Spark gives a file of a few MB to a few tasks, however much
    work its rows are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VIEWS["catalog"], part=spread(table(spark, sf_dir, "part")))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "predictions")


def request_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service requests: ``service``, ``is_error``, ``latency_ms``, scored and fallback rows, batch quality policy."""
    return view(spark, sf_dir, "service_requests").withColumn("ts", F.col("ts").cast("timestamp"))

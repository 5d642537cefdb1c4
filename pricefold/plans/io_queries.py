"""Source, sink, schema and JSON queries (SRC-*, SNK-*, SCH-1/2/3, JSN-*, DAT-2, MET-21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as G
from ..operators import metrics as M
from ..operators import monitoring as MON
from ..operators import split as SP
from ..session import scratch_dir
from ..sources import catalog_io as IO
from ..sources import tables as S
from .registry import query


def r6(c):
    return F.round(c, 6)


@query("catalog_csv_alias_roundtrip", "SRC-1 SRC-2 SRC-3 SRC-4 SCH-1 SCH-3 SNK-1", oracle="""
SELECT sample_id, coalesce(catalog_content, '') AS catalog_content, coalesce(image_link, '') AS image_link, price
FROM catalog
""")
def catalog_csv_alias_roundtrip(spark, sf_dir):
    cat = S.catalog(spark, sf_dir).withColumnsRenamed(
        {"sample_id": "unique_identifier", "catalog_content": "Description", "image_link": "image_path",
         "price": "Price"})
    path = scratch_dir(spark, "catalog-csv")
    IO.write_csv(cat, path)
    IO.write_parquet(IO.prepare_training_data(IO.load_train_df(spark, path)), path + "-columns")
    return spark.read.parquet(path + "-columns")


@query("test_csv_contract", "SRC-2 SCH-3", oracle="""
SELECT sample_id, length(coalesce(catalog_content, '')) AS text_chars FROM catalog
""")
def test_csv_contract(spark, sf_dir):
    """The test contract: the same columns without a price."""
    path = scratch_dir(spark, "test-csv")
    IO.write_csv(S.catalog(spark, sf_dir).drop("price").withColumnsRenamed({"sample_id": "unique_identifier"}), path)
    out = IO.load_test_df(spark, path)
    return out.select("sample_id", F.length(F.coalesce("catalog_content", F.lit(""))).cast("long").alias("text_chars"))


@query("latency_log_roundtrip", "SRC-5 SNK-2 MET-14", oracle="""
SELECT count(*) AS runs,
       round(coalesce(quantile_cont(total_seconds, 0.5), 0), 6) AS p50_total_seconds,
       round(coalesce(quantile_cont(total_seconds, 0.95), 0), 6) AS p95_total_seconds,
       round(coalesce(quantile_cont(total_seconds, 0.99), 0), 6) AS p99_total_seconds,
       round(coalesce(quantile_cont(seconds_per_row, 0.95), 0), 6) AS p95_seconds_per_row
FROM latency_events
""")
def latency_log_roundtrip(spark, sf_dir):
    ev = S.view(spark, sf_dir, "latency_events")
    path = scratch_dir(spark, "latency-jsonl")
    ev.select("run_id", F.col("rows_scored").cast("int").alias("rows"), "total_seconds", "predict_seconds",
              "seconds_per_row", F.lit(None).cast("string").alias("output_path"),
              F.col("ts_utc").cast("timestamp").alias("ts_utc")).write.mode("overwrite").json(path)
    s = MON.latency_summary(IO.load_latency_events(spark, path))
    return s.select("runs", *[r6(F.col(c)).alias(c) for c in s.columns if c != "runs"])


# a payload for every 300 items: items 0-149 of it form one body, the other 150 come with 60 items of the next
# one (an overlap), so that bodies of 150 and of 210 records and broken bodies occur at every scale
_PAYLOADS = """
pay AS (SELECT sample_id // 300 * 10 + CASE WHEN sample_id % 300 < 150 THEN 1 ELSE 2 END AS payload_id FROM catalog
        UNION ALL SELECT sample_id // 300 * 10 + 2 FROM catalog WHERE sample_id % 300 < 60),
bodies AS (SELECT payload_id, count(*) AS n FROM pay GROUP BY 1),
st AS (SELECT payload_id, CASE WHEN payload_id % 70 = 11 THEN -1 ELSE n END AS n_records FROM bodies)
"""


def _payloads(spark, sf_dir):
    """Request bodies built by Spark from the catalog; some are over the limit, some are not JSON."""
    cat = S.catalog(spark, sf_dir).select("sample_id", "catalog_content", "image_link")
    block = F.floor(F.col("sample_id") / 300) * 10
    own = cat.withColumn("payload_id", block + F.when(F.col("sample_id") % 300 < 150, 1).otherwise(2))
    also = cat.where(F.col("sample_id") % 300 < 60).withColumn("payload_id", block + 2)
    bodies = own.unionByName(also).groupBy("payload_id").agg(F.to_json(F.struct(F.collect_list(
        F.struct("sample_id", "catalog_content", "image_link")).alias("records"))).alias("body"))
    return bodies.withColumn("body", F.when(F.col("payload_id") % 70 == 11, F.concat(F.lit("{broken"), "body"))
                             .otherwise(F.col("body")))


@query("records_payload_status", "SRC-6", oracle=f"""
WITH {_PAYLOADS}
SELECT payload_id, n_records, CASE WHEN n_records < 0 THEN 'malformed'
       WHEN n_records > 200 THEN 'too_many_records:' || n_records || '>200' ELSE 'accepted' END AS status FROM st
""")
def records_payload_status(spark, sf_dir):
    out = IO.payload_status(_payloads(spark, sf_dir))
    return out.select("payload_id", F.col("n_records").cast("long").alias("n_records"), "status")


@query("records_payload_table", "SRC-6", oracle=f"""
WITH {_PAYLOADS}
SELECT payload_id, n_records FROM st WHERE n_records BETWEEN 0 AND 200
""")
def records_payload_table(spark, sf_dir):
    recs = IO.records_to_table(_payloads(spark, sf_dir))
    return recs.groupBy("payload_id").agg(F.count(F.lit(1)).alias("n_records"))


@query("pending_image_downloads", "SRC-7", oracle="""
WITH w AS (SELECT DISTINCT string_split(image_link, '/')[-1] AS file_name FROM catalog WHERE image_link <> ''),
f AS (SELECT DISTINCT string_split(image_link, '/')[-1] AS file_name FROM catalog WHERE image_link <> '' AND sample_id % 3 = 0)
SELECT file_name FROM w WHERE file_name NOT IN (SELECT file_name FROM f)
""")
def pending_image_downloads(spark, sf_dir):
    cat = S.catalog(spark, sf_dir)
    fetched = cat.where((F.col("sample_id") % 3 == 0) & (F.col("image_link") != "")) \
                 .select(F.element_at(F.split("image_link", "/"), -1).alias("file_name"))
    return IO.pending_downloads(cat, fetched).select("file_name")


@query("events_json_fields", "JSN-1 DAT-2", oracle="""
SELECT event_id, CAST(coalesce(json_extract_string(props, '$.k'), json_extract_string(props, '$.meta.k')) AS BIGINT) AS k,
       'evt_' || strftime(ts, '%Y%m%dT%H%M%SZ') AS run_id
FROM events
""")
def events_json_fields(spark, sf_dir):
    ev = S.table(spark, sf_dir, "events")
    return ev.select("event_id", IO.json_field(F.col("props"), "$.k", "$.meta.k").cast("long").alias("k"),
                     IO.run_id_from_ts("evt", F.col("ts")).alias("run_id"))


@query("flattened_service_report", "JSN-2 SNK-3", oracle="""
SELECT event_type AS service, count(*) AS "metrics.requests",
       round(avg(value), 6) AS "metrics.mean_latency_ms",
       array_to_string(list_sort(list_distinct(list(CAST(user_id % 3 AS VARCHAR)))), ',') AS "tags"
FROM events GROUP BY event_type
""")
def flattened_service_report(spark, sf_dir):
    ev = S.table(spark, sf_dir, "events")
    nested = ev.groupBy(F.col("event_type").alias("service")).agg(
        F.struct(F.count(F.lit(1)).alias("requests"), r6(F.avg("value")).alias("mean_latency_ms")).alias("metrics"),
        F.array_sort(F.collect_set((F.col("user_id") % 3).cast("string"))).alias("tags"))
    path = scratch_dir(spark, "service-report")
    IO.write_json_report(nested, path)  # SNK-3: nested report as JSON
    back = spark.read.schema(nested.schema).json(path)
    return IO.flatten(back)


_FOLD_SMAPE = """
long AS (SELECT sample_id, y, 'p_a' AS model, p_a AS pred FROM predictions
         UNION ALL SELECT sample_id, y, 'p_b', p_b FROM predictions),
f AS (SELECT model, CAST(CAST(('0x' || substr(md5(CAST(sample_id AS VARCHAR) || ':42'), 1, 8)) AS BIGINT) % 5 AS INTEGER) AS fold,
             avg(100.0 * abs(pred - y) / greatest((abs(y) + abs(pred)) / 2.0, 1e-8)) AS smape FROM long GROUP BY ALL)
"""


def _fold_smape(spark, sf_dir):
    long = M.long_predictions(S.predictions(spark, sf_dir), "sample_id", "y", ["p_a", "p_b"])
    f = M.regression_metrics(SP.kfold(long, "sample_id", 5, 42), "y", "pred", ["model", "fold"])
    return f.select("model", "fold", F.round("smape", 6).alias("smape"))


@query("best_fold_by_smape", "MET-21", oracle=f"""
WITH {_FOLD_SMAPE}
SELECT model, arg_min(fold, round(smape, 6)) AS best_fold, min(round(smape, 6)) AS best_smape FROM f GROUP BY model
""")
def best_fold_by_smape(spark, sf_dir):
    """Read from a report table of texts, in which an entry that is no number never wins."""
    extra = spark.createDataFrame([("p_a", 9, "n/a"), ("p_b", 9, None)], "model string, fold int, smape string")
    t = _fold_smape(spark, sf_dir).withColumn("smape", F.col("smape").cast("string")).unionByName(extra)
    v = F.col("smape").try_cast("double")
    return t.groupBy("model").agg(F.min_by("fold", v).alias("best_fold"), F.min(v).alias("best_smape"))


@query("training_gate", "SLO-3", oracle=f"""
WITH {_FOLD_SMAPE}, r AS (SELECT model, round(smape, 6) AS smape, 120.0 AS total FROM f
  UNION ALL SELECT 'slow', round(smape, 6), 7200.0 FROM f
  UNION ALL SELECT 'not_finite', 'nan'::DOUBLE, 60.0 FROM f
  UNION ALL SELECT 'untimed', round(smape, 6), NULL FROM f),
b AS (SELECT model, min(smape) AS best_smape, max(total) AS total FROM r GROUP BY model)
SELECT model, best_smape, isfinite(best_smape) AND coalesce(total, 0) <= 3600 AS passed,
       concat_ws(',', CASE WHEN NOT isfinite(best_smape) THEN 'smape_not_finite' END,
                 CASE WHEN total > 3600 THEN 'training_time' END) AS failures
FROM b
""")
def training_gate(spark, sf_dir):
    """SLO-3 on reports that pass, took too long, hold no finite SMAPE, or carry no time."""
    f = _fold_smape(spark, sf_dir)
    report = lambda name, smape, total: f.select(                                              # noqa: E731
        name.alias("model"), smape.alias("smape"), F.lit(total).cast("double").alias("total_seconds"))
    rows = (report(F.col("model"), F.col("smape"), 120.0).unionByName(report(F.lit("slow"), F.col("smape"), 7200.0))
            .unionByName(report(F.lit("not_finite"), F.lit(float("nan")), 60.0))
            .unionByName(report(F.lit("untimed"), F.col("smape"), None)))
    return G.training_gate(rows, max_train_seconds=3600)

"""Structured Streaming jobs (STR-1 .. STR-6).

Sources are the tables' own folders with explicit schemas; ``maxFilesPerTrigger`` is left to the caller.  ``ts`` is cast to
TIMESTAMP (session time zone UTC) before any watermark, because TIMESTAMP_NTZ cannot carry one.  Aggregations run
in append mode: a window is written once, when the watermark has passed its end, and its state is freed.  Sinks are
``foreachBatch`` writers to shared storage, idempotent per ``batch_id``: a retried micro-batch overwrites its own
output.  State is one row per (window, key); only counts, sums and sketches are kept, never raw values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import monitoring as MON
from ..operators import quality as Q
from ..session import scratch_dir

WATERMARK = "10 minutes"


def read_stream(spark: SparkSession, path: str, schema, max_files: int | None = None, files: str | None = None) -> DataFrame:
    """A folder's files as a stream; ``files`` is a glob over their names."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if files:
        reader = reader.option("pathGlobFilter", files)
    return reader.parquet(path)


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A shared table as a stream of its files; the table is a folder, or one file of the shared folder."""
    root = sf_dir.rstrip("/")
    path = f"{root}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(hadoop).isDirectory():
        return read_stream(spark, path, schema, max_files)
    return read_stream(spark, root, schema, max_files, files=f"{name}.parquet")


def event_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    return table_stream(spark, sf_dir, "events", max_files).withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, name: str, write: Callable[[DataFrame, str], None] | None = None) -> tuple[str, dict]:
    """Run a stream in append mode until the available input is consumed; every micro-batch goes to its own folder
    (``write(batch, folder)`` where a batch is more than its rows).  Returns (result path, progress)."""
    spark = stream.sparkSession
    out_path = scratch_dir(spark, f"stream-out-{name}")
    ckpt = scratch_dir(spark, f"stream-ckpt-{name}")

    def sink(batch_df: DataFrame, batch_id: int):
        folder = f"{out_path}/batch_id={batch_id}"
        if write:
            write(batch_df, folder)
        else:
            batch_df.write.mode("overwrite").parquet(folder)

    q = (stream.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path, {"dropped_by_watermark": dropped_rows(q), "batches": len(q.recentProgress)}


def dropped_rows(q) -> int:
    """``numRowsDroppedByWatermark`` of the stateful operators, summed over the
    run's micro-batches, as Spark reports it.  Spark may filter late rows before
    the operator, in which case this stays 0 while the rows are still dropped."""
    total = 0
    for p in q.recentProgress:
        for op in p.get("stateOperators", []) if isinstance(p, dict) else []:
            total += int(op.get("numRowsDroppedByWatermark", 0) or 0)
    return total


def tumbling_stats(stream: DataFrame, window: str = "1 day", watermark: str = WATERMARK, key: str = "event_type") -> DataFrame:
    """STR-1: per (window, key): count, total, max and p50 / p95 from a bounded sketch (exact percentiles would keep
    every value in state)."""
    agg = (stream.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"), key)
           .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total_value"), F.max("value").alias("max_value"),
                F.percentile_approx("value", [0.5, 0.95], 10000).alias("q")))
    return agg.select(F.col("w.start").alias("window_start"), key, "n", "total_value", "max_value",
                      F.col("q")[0].alias("p50_value"), F.col("q")[1].alias("p95_value"))


def sliding_service_metrics(requests: DataFrame, length: str = "1 day", slide: str = "12 hours",
                            watermark: str = WATERMARK) -> DataFrame:
    """STR-2: MET-15's counters and rates per service over sliding windows."""
    agg = (requests.withWatermark("ts", watermark).groupBy(F.window("ts", length, slide).alias("w"), "service")
           .agg(*MON.service_counts()))
    return MON.with_rates(agg.select(F.col("w.start").alias("window_start"), "service", *MON.SERVICE_COUNTS))


def quality_sink(required: list[str], bounds: dict, max_null_rate: float) -> Callable[[DataFrame, str], None]:
    """STR-3 / SNK-4: DQ-1 decides on the whole micro-batch.  ``allow`` goes on to scoring; ``quarantine`` does too, and its
    input is copied aside; ``reject`` is only kept as rejected.  Rows carry their own route (DQ-2)."""
    def write(batch: DataFrame, folder: str) -> None:
        policy = Q.validate_batch_quality(batch, required, max_null_rate, bounds).select("policy").first()["policy"]
        rows = Q.route_rows(batch, required, bounds).withColumn("policy", F.lit(policy))
        targets = {"allow": ["scoring"], "quarantine": ["scoring", "quarantine"], "reject": ["rejected"]}[policy]
        for target in targets:
            rows.withColumn("target", F.lit(target)).write.mode("overwrite").parquet(f"{folder}/part={target}")
    return write


def drift_snapshots(stream: DataFrame, edges: DataFrame, features: list[str], window: str = "1 day",
                    watermark: str = WATERMARK) -> DataFrame:
    """STR-4: bucket counts per (window, feature, bucket) against fixed reference
    edges (a small static table: one row per feature, joined by broadcast)."""
    long = stream.select("ts", *[F.col(c).cast("double").alias(c) for c in features]) \
                 .unpivot(["ts"], features, "feature", "x").where(F.col("x").isNotNull() & ~F.isnan("x"))
    b = long.join(F.broadcast(edges), "feature") \
            .withColumn("bucket", F.size(F.filter("edges", lambda e: F.col("x") >= e)))
    return (b.withWatermark("ts", watermark)
            .groupBy(F.window("ts", window).alias("w"), "feature", "bucket")
            .agg(F.count(F.lit(1)).alias("cnt"))
            .select(F.col("w.start").alias("window_start"), "feature", "bucket", "cnt"))


def psi_from_snapshots(snap: DataFrame, ref_shares: DataFrame, eps: float = 1e-9) -> DataFrame:
    """PSI per (window, feature) from streamed bucket counts and the reference
    bucket shares (reference buckets absent from a window count as empty)."""
    tot = snap.groupBy("window_start", "feature").agg(F.sum("cnt").alias("tot"))
    grid = tot.join(ref_shares, "feature")
    j = grid.join(snap, ["window_start", "feature", "bucket"], "left")
    c = F.greatest(F.coalesce(F.col("cnt"), F.lit(0)) / F.col("tot"), F.lit(eps))
    r = F.greatest(F.col("ref_share"), F.lit(eps))
    return j.groupBy("window_start", "feature").agg(F.sum((c - r) * F.log(c / r)).alias("psi"))


def alert_rows(psi: DataFrame, warn: float = 0.2, critical: float = 0.3) -> DataFrame:
    """STR-5: drift alerts from the snapshot PSI."""
    sev = F.when(F.col("psi") >= critical, "critical").when(F.col("psi") >= warn, "warning")
    return psi.withColumn("severity", sev).where(F.col("severity").isNotNull())


def alert_sink(ref_shares: DataFrame) -> Callable[[DataFrame, str], None]:
    """STR-4 and STR-5 inside ``foreachBatch``: in append mode all buckets of a window close in the same micro-batch, so
    its PSI is final there; snapshots and alerts are written side by side."""
    def write(batch: DataFrame, folder: str) -> None:
        psi = psi_from_snapshots(batch, ref_shares)
        psi.write.mode("overwrite").parquet(f"{folder}/part=psi")
        alert_rows(psi).write.mode("overwrite").parquet(f"{folder}/part=alerts")
    return write


def score_stream(stream: DataFrame, model, id_col: str, canary_percent: float = 10.0) -> DataFrame:
    """STR-6: ``PipelineModel.transform`` on a stream plus the stable canary route."""
    from ..operators.split import canary_route
    return canary_route(model.transform(stream), id_col, canary_percent)

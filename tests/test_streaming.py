"""Streaming jobs give the batch answer for every closed window."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from pricefold.operators import quality as Q
from pricefold.plans import QUERIES
from pricefold.session import scratch_dir
from pricefold.sources import tables as S
from pricefold.streaming import jobs as J


def test_tumbling_stream_equals_batch(spark):
    got = QUERIES["stream_tumbling_event_stats"](spark, SF_SMALL).select("window_start", "event_type", "n", "total_value", "max_value")
    ev = S.table(spark, SF_SMALL, "events").withColumn("day", F.date_trunc("day", "ts"))
    newest = ev.agg(F.max("ts")).first()[0]
    batch = ev.where(F.col("day") + F.expr("INTERVAL 1 DAY") <= F.lit(newest) - F.expr("INTERVAL 10 MINUTES")) \
        .groupBy(F.date_format("day", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type") \
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total_value"), F.max("value").alias("max_value"))
    assert got.count() > 20 and got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_each_micro_batch_follows_its_own_policy(spark):
    src = scratch_dir(spark, "dq-src")
    rows = [[(1, "a", 5.0), (2, "b", 6.0)], [(3, None, 5.0), (4, "b", 7.0)], [(5, "a", -1.0), (6, None, 2.0)]]
    for part in rows:
        spark.createDataFrame(part, "sample_id long, t string, price double").coalesce(1).write.mode("append").parquet(src)
    stream = J.read_stream(spark, src, "sample_id long, t string, price double", max_files=1)
    path, progress = J.run_to_table(stream, "dq", J.quality_sink(["sample_id", "t"], {"price": (0.0, 10.0)}, 0.4))
    got = {}
    for r in spark.read.parquet(path).collect():
        got.setdefault(r.target, set()).add((r.sample_id, r.policy, r.dq_route))
    assert got["scoring"] == {(1, "allow", "allow"), (2, "allow", "allow"), (3, "quarantine", "quarantine"), (4, "quarantine", "allow")}
    assert got["quarantine"] == {(3, "quarantine", "quarantine"), (4, "quarantine", "allow")}     # a copy, scored as well
    assert got["rejected"] == {(5, "reject", "reject"), (6, "reject", "quarantine")}
    assert progress["batches"] >= 3
    one = spark.createDataFrame(rows[1], "sample_id long, t string, price double")
    assert Q.validate_batch_quality(one, ["sample_id", "t"], 0.4).first()["policy"] == "quarantine"


def test_stream_scoring_routes(spark):
    out = QUERIES["stream_scoring"](spark, SF_SMALL)
    part = S.table(spark, SF_SMALL, "part")
    assert out.count() == part.count()
    assert out.select("p_partkey").distinct().count() == part.count()

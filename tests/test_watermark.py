"""Watermarked windows in append mode: a window is emitted once, after the watermark passes its end.
Spark does not promise to drop rows behind the watermark (they may still be aggregated)."""

import glob
import os
import shutil

from pyspark.sql import functions as F

from pricefold.session import scratch_dir
from pricefold.streaming import jobs as J


def test_windows_close_with_watermark(spark):
    flat = scratch_dir(spark, "wm-flat").replace("file:", "")
    os.makedirs(flat)
    batches = [[("2024-01-20 10:00:00", "a", 1.0), ("2024-01-22 09:00:00", "a", 4.0)],
               [("2024-01-18 10:00:00", "a", 100.0)]]
    for i, rows in enumerate(batches):  # one file per micro-batch, in this order
        tmp = scratch_dir(spark, f"wm{i}")
        spark.createDataFrame(rows, "t string, event_type string, value double") \
             .select(F.to_timestamp("t").alias("ts"), "event_type", "value").coalesce(1).write.parquet(tmp)
        src = glob.glob(tmp.replace("file:", "") + "/*.parquet")[0]
        dst = f"{flat}/{i:02d}.parquet"
        shutil.copy(src, dst)
        os.utime(dst, (1_700_000_000 + 10 * i,) * 2)
    stream = spark.readStream.schema("ts timestamp, event_type string, value double") \
        .option("maxFilesPerTrigger", 1).parquet(flat)
    path, progress = J.run_to_table(J.tumbling_stats(stream, window="1 day", watermark="1 hour"), "wm")
    out = spark.read.parquet(path)
    assert progress["batches"] >= 2
    # every emitted window is emitted exactly once
    assert out.groupBy("window_start", "event_type").count().where("count > 1").count() == 0
    # the 2024-01-20 window closed when the watermark passed it and was emitted once
    assert out.where(F.to_date("window_start") == F.lit("2024-01-20").cast("date")).count() == 1

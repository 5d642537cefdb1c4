"""The rolling latency buffer as stream state (STR-2 with WIN-1), by ``transformWithState``.

Every (service, share) keeps its newest ``window_rows`` requests by (time, id), whatever order they come in, so its state is bounded
and does not depend on how the input is cut into micro-batches.  Requests are dealt to shares by their id, which spreads a hot
service over many tasks; the newest ``window_rows`` of all its shares' buffers are those of the service.  A share without
requests for ``idle_ms`` of event time gives its buffer out for the last time and its state is freed; the sink then holds what the
service's window may still need of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import WATERMARK, run_to_table

SHARES = 16
IDLE_MS = 7 * 24 * 3600 * 1000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUFFER = "at array<long>, id array<long>, ms array<double>"
OUT = f"service string, share long, status string, {BUFFER}"


def newest(at: np.ndarray, ids: np.ndarray, ms: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``n`` newest requests, oldest first; of requests of equal time those of greater id are newer."""
    keep = np.lexsort((ids, at))[-n:]
    return at[keep], ids[keep], ms[keep]


class LatencyBuffer(StatefulProcessor):
    """Puts each micro-batch's requests into the buffer and gives the buffer out once per batch."""

    def __init__(self, window_rows: int, idle_ms: int):
        self.window_rows, self.idle_ms = window_rows, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getValueState("buffer", BUFFER)

    def _row(self, key, status, at=(), ids=(), ms=()) -> pd.DataFrame:
        return pd.DataFrame({"service": [key[0]], "share": [key[1]], "status": [status], "at": [list(at)], "id": [list(ids)], "ms": [list(ms)]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.buffer.exists():
            at, ids, ms = (np.asarray(c, dtype=t) for c, t in zip(self.buffer.get(), ("int64", "int64", "float64")))
        else:
            at, ids, ms = np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0)
        for part in rows:
            at, ids, ms = newest(np.concatenate([at, part["at"].to_numpy("int64")]), np.concatenate([ids, part["id"].to_numpy("int64")]),
                                 np.concatenate([ms, part["ms"].to_numpy("float64")]), self.window_rows)
        out = at.tolist(), ids.tolist(), ms.tolist()
        self.buffer.update(out)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        # a share whose newest request is already behind the watermark ends with the next batch
        self.handle.registerTimer(max(int(at[-1]) // 1000 + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._row(key, "live", *out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.buffer.get()
        self.buffer.clear()
        yield self._row(key, "idle", *last)

    def close(self) -> None:
        pass


def latency_buffers(requests: DataFrame, window_rows: int = 5000, idle_ms: int = IDLE_MS, shares: int = SHARES,
                    watermark: str = WATERMARK) -> DataFrame:
    """The stream of buffers: a row per (service, share) and micro-batch with requests of it, and one when it goes idle.  A request
    without a latency (null or NaN) takes its place in the buffer; one without a time or id is left out."""
    rows = requests.withWatermark("ts", watermark).where("ts IS NOT NULL AND event_id IS NOT NULL").select(
        "ts", "service", F.pmod(F.xxhash64("event_id"), F.lit(shares)).alias("share"), F.unix_micros("ts").alias("at"),
        F.col("event_id").cast("long").alias("id"), F.coalesce(F.col("latency_ms").cast("double"), F.lit(float("nan"))).alias("ms"))
    return rows.groupBy("service", "share").transformWithStateInPandas(LatencyBuffer(window_rows, idle_ms), OUT, "append", "EventTime")


def run_latency_buffers(requests: DataFrame, name: str = "rolling", **options) -> tuple[str, dict]:
    """Run to the end of the available input; every micro-batch's buffers go to their own folder.  The state store must be RocksDB
    for this operator; the session's own choice is put back."""
    spark = requests.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return run_to_table(latency_buffers(requests, **options), name)
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def rolling_percentiles(spark: SparkSession, path: str, window_rows: int = 5000, live_only: bool = False) -> DataFrame:
    """Percentiles of every service's buffer after the last micro-batch, or of those only that still have state.  A service's rows are
    the last buffer of each share and those it gave out when it went idle, ``window_rows`` each at most."""
    last = Window.partitionBy("service", "share").orderBy(F.desc("batch_id"))
    now = spark.read.parquet(path).withColumn("_n", F.row_number().over(last)).where("_n = 1 OR status = 'idle'")
    if live_only:
        now = now.withColumn("_live", F.max(F.col("status") == "live").over(Window.partitionBy("service"))).where("_live")
    rows = now.select("service", F.explode(F.arrays_zip("at", "id", "ms")).alias("r")).select("service", "r.*")
    recent = Window.partitionBy("service").orderBy(F.desc("at"), F.desc("id"))
    rows = rows.withColumn("_n", F.row_number().over(recent)).where(F.col("_n") <= window_rows)
    return rows.groupBy("service").agg(F.percentile(F.when(~F.isnan("ms"), F.col("ms")), [0.5, 0.95, 0.99]).alias("q")).select(
        "service", *[F.col("q")[i].alias(c) for i, c in enumerate(("p50_ms", "p95_ms", "p99_ms"))], F.lit(window_rows).alias("window_rows"))

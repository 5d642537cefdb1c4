"""Percentiles of each request's last ``window_rows`` requests (WIN-1, the rolling latency buffer at any moment).

Requests are ranked in time order per service over many partitions (``rank_within``) and dealt to blocks of ranks; a block
also gets the ``window_rows - 1`` requests before it, so that a hot service is many tasks and none needs its neighbour's
result.  Inside a block one ordered array follows the window: each step puts one value in, takes one out, and reads the ranks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import rank_within

BLOCK_ROWS = 20_000


class OrderedWindow:
    """The last ``size`` values, in order."""

    def __init__(self, size: int):
        self.size, self.n, self.at = size, 0, 0
        self.ring, self.ordered = np.empty(size), np.empty(size + 1)

    def push(self, x: float) -> None:
        s = self.ordered
        if self.n == self.size:
            k = int(np.searchsorted(s[: self.n], self.ring[self.at]))
            s[k: self.n - 1] = s[k + 1: self.n]
            self.n -= 1
        k = int(np.searchsorted(s[: self.n], x))
        s[k + 1: self.n + 1] = s[k: self.n]
        s[k] = x
        self.ring[self.at] = x
        self.at, self.n = (self.at + 1) % self.size, self.n + 1

    def percentile(self, p: float) -> float:
        pos = (self.n - 1) * p
        k = int(pos)
        low = self.ordered[k]
        return float(low + (self.ordered[min(k + 1, self.n - 1)] - low) * (pos - k))


def sliding_percentiles(requests: DataFrame, value: str = "latency_ms", time: str = "ts", id_col: str = "event_id", by: str = "service",
                        probs: dict[str, float] | None = None, window_rows: int = 5000, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per request of a value: its group, id, rank in time, the number of values in its window, and their percentiles.
    Requests of equal time come in order of their id; those without a value are not in the buffer."""
    probs = probs or {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    block_rows = max(block_rows, window_rows)
    rows = requests.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))) \
        .select(F.col(by).alias("_by"), F.col(id_col).cast("long").alias("_id"), F.unix_micros(F.col(time).cast("timestamp")).alias("_at"),
                F.col(value).cast("double").alias("_v"))
    ranked = rank_within(rows, ["_at", "_id"], ["_by"], rank_col="_r").select("_by", "_id", "_r", "_v")
    block = F.floor(F.col("_r") / block_rows)
    near_end = F.col("_r") % block_rows >= block_rows - (window_rows - 1)
    places = F.when(near_end, F.array(block, block + 1)).otherwise(F.array(block))
    dealt = ranked.select("*", F.explode(places).alias("_block")).withColumn("_own", F.col("_block") == block)
    kind = dict(rows.dtypes)["_by"]
    names = ["_by", "_id", "_r", "n", *probs]

    def run(batches):
        key, window = None, OrderedWindow(window_rows)
        for b in batches:
            out = []
            for g, i, r, v, k, own in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_by", "_id", "_r", "_v", "_block", "_own"))):
                if (g, k) != key:
                    key, window = (g, k), OrderedWindow(window_rows)
                window.push(v)
                if own:
                    out.append((g, i, r, window.n, *[window.percentile(p) for p in probs.values()]))
            if out:
                cols = list(zip(*out))
                types = [b.schema.field("_by").type, pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * len(probs)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    out = dealt.repartition("_by", "_block").sortWithinPartitions("_by", "_block", "_r") \
        .mapInArrow(run, f"_by {kind}, _id long, _r long, n long, " + ", ".join(f"{c} double" for c in probs))
    return out.withColumnsRenamed({"_by": by, "_id": id_col, "_r": "rank", "n": "window_rows"})

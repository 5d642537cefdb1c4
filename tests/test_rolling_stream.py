"""The latency buffer as stream state: stream equals batch, bounded, freed when idle."""

from pyspark.sql import functions as F

from pricefold.session import scratch_dir
from pricefold.streaming import jobs as J
from pricefold.streaming import rolling as R

SCHEMA = "event_id long, ts timestamp, service string, latency_ms double"


def _rows():
    rows = []
    for i in range(600):
        service = "hot" if i % 3 else f"s{i % 5}"
        rows.append((i, i // 2, service, None if i % 41 == 0 else float((i * 7919) % 1009)))
    rows += [(1000 + i, 5, "early", float(i)) for i in range(10)]
    rows += [(2000 + i, 50_000 + i // 3, "late", float(i % 7)) for i in range(30)]
    return rows


def _write(spark, folder, rows, name):
    df = spark.createDataFrame(rows, "event_id long, s long, service string, latency_ms double")
    df = df.select("event_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")).alias("ts"), "service", "latency_ms")
    df.coalesce(1).write.mode("append").parquet(folder)


def _want(rows, window):
    out = {}
    for service in {r[2] for r in rows}:
        last = sorted((s, i, ms) for i, s, name, ms in rows if name == service)[-window:]
        out[service] = sorted(ms for _, _, ms in last if ms is not None)
    return out


def _percentile(values, p):
    at = (len(values) - 1) * p
    low = values[int(at)]
    return low + (values[min(int(at) + 1, len(values) - 1)] - low) * (at - int(at))


def test_stream_equals_batch_and_state_is_freed(spark):
    folder, rows, window = scratch_dir(spark, "requests"), _rows(), 40
    in_time = sorted(rows, key=lambda r: r[1])
    for at in range(0, len(in_time), 160):
        _write(spark, folder, in_time[at: at + 160], "part")
    stream = J.read_stream(spark, folder, SCHEMA, max_files=1)
    path, _ = R.run_latency_buffers(stream, window_rows=window, idle_ms=3_600_000, shares=3)
    out = spark.read.parquet(path)
    assert out.select(F.max(F.size("at"))).first()[0] <= window
    live = {r.service for r in R.rolling_percentiles(spark, path, window, live_only=True).collect()}
    # only the last service had a request within an hour of the end: the others' shares were given out as idle and freed
    assert live == {"late"}
    idle = {r.service for r in out.where("status = 'idle'").collect()}
    assert idle == {r[2] for r in rows} - {"late"}
    got = {r.service: (r.p50_ms, r.p95_ms) for r in R.rolling_percentiles(spark, path, window).collect()}
    want = {k: (_percentile(v, 0.5), _percentile(v, 0.95)) for k, v in _want(rows, window).items()}
    assert {k: tuple(round(x, 9) for x in v) for k, v in got.items()} == {k: tuple(round(x, 9) for x in v) for k, v in want.items()}


def test_any_cut_into_batches_gives_the_same_buffers(spark):
    rows, window = [r for r in _rows() if r[1] < 1000], 25
    want = {k: [_percentile(v, p) for p in (0.5, 0.95, 0.99)] for k, v in _want(rows, window).items()}
    for size in (len(rows), 150):
        folder = scratch_dir(spark, "requests")
        mixed = sorted(rows, key=lambda r: (r[0] * 31) % 97)
        for at in range(0, len(mixed), size):
            _write(spark, folder, mixed[at: at + size], "part")
        path, _ = R.run_latency_buffers(J.read_stream(spark, folder, SCHEMA, max_files=1), window_rows=window, shares=4)
        got = {r.service: [round(x, 9) for x in (r.p50_ms, r.p95_ms, r.p99_ms)] for r in R.rolling_percentiles(spark, path, window).collect()}
        assert got == {k: [round(x, 9) for x in v] for k, v in want.items()}

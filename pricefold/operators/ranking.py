"""Exact ranks and percentiles without pulling a group into one task.

``exact_percentiles`` brackets each wanted rank with a mergeable sketch (``percentile_approx``), then counts in
one aggregate how many values lie between the brackets and how often each value inside one occurs.  Equal values
collapse to one counted row before the shuffle, so neither a hot group nor a hot value reaches a single task, and
no values are sorted or written.  A bracket of too many rows is counted by cells and narrowed first, so what one task
orders is bounded at any size.  Bracket tables are written to the shared folder (a row per group), so the join with them is
planned by their true size; without groups the one bracket row enters as literals and there is no join.  Ranks are
interpolated linearly (numpy ``linear``, Spark ``percentile``, DuckDB ``quantile_cont``).

``rank_within`` numbers the rows of each group: it range-partitions on (group, order) keys, so a hot group is
spread over many partitions as long as the order keys differ (give a total order; equal keys stay together).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOCAL_BITS = 33  # monotonically_increasing_id: partition id << 33 | row index
_SKETCH = 10_000                       # percentile_approx: rank error of n / _SKETCH at most
_SMALL, _MIDDLE = 1_000, 1_000_000     # below: all values are the bracket; below: wide brackets
_BOUND, _CELLS, _ROUNDS = 20_000, 4_096, 40


def _partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def rank_within(df: DataFrame, order_cols: list[str], group_cols: list[str] | None = None,
                rank_col: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based position of each row in ``order_cols`` order inside its group.
    Give a total order (add a unique tie-break column) when positions must be
    repeatable; for percentiles ties do not matter."""
    return _rank_with_counts(df, order_cols, group_cols, rank_col, num_partitions)[0]


def _rank_with_counts(df: DataFrame, order_cols: list[str], group_cols: list[str] | None = None,
                      rank_col: str = "rank", num_partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``rank_within`` plus the row count per group (from the small statistics
    table of the checkpointed ranks; no second pass over the input)."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)  # cluster value if set, else a scratch dir (tests)
    group_cols = list(group_cols or [])
    keys = group_cols + list(order_cols)
    p = _partitions(df, num_partitions)
    # One evaluation fixes each row's (partition, local index).  The sorted,
    # indexed table is written once to the shared checkpoint dir.  Otherwise
    # the statistics branch and the row branch would each re-run the range
    # exchange; Catalyst may prune them differently or drop the sort below the
    # aggregate, and the indexes would disagree.  It also cuts the lineage.
    keyed = (df.repartitionByRange(p, *keys).sortWithinPartitions(*keys)
             .withColumn("_pid", F.spark_partition_id().cast("long"))
             .withColumn("_local", F.monotonically_increasing_id()
                         - F.shiftleft(F.spark_partition_id().cast("long"), _LOCAL_BITS))
             .checkpoint(eager=True))
    stats = keyed.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_n"), F.min("_local").alias("_first"))
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1) \
        if group_cols else Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    offsets = offsets.select(*[F.col(c).alias(f"_o_{c}") for c in ["_pid"] + group_cols], "_off", "_first")
    cond = reduce(lambda a, b: a & b,
                  [keyed["_pid"] == offsets["_o__pid"]] +
                  [keyed[c].eqNullSafe(offsets[f"_o_{c}"]) for c in group_cols])
    joined = keyed.join(offsets, cond, "inner")
    out = joined.withColumn(rank_col, F.col("_off") + F.col("_local") - F.col("_first"))
    counts = stats.groupBy(*group_cols).agg(F.sum("_n").alias("_cnt"))
    return out.drop("_pid", "_local", "_off", "_first", *[f"_o_{c}" for c in ["_pid"] + group_cols]), counts


def _clip(p: float) -> float:
    return min(1.0, max(0.0, p))


def stored(df: DataFrame, name: str) -> DataFrame:
    """A small table, written to the shared folder once and read back: its true size is known to the planner."""
    from ..session import scratch_dir
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exact_percentiles(df: DataFrame, value_col: str, probs: list[float], group_cols: list[str] | None = None,
                      bound: int = _BOUND) -> DataFrame:
    """Long result: (group..., prob, value).  Nulls and NaN are skipped; groups with no values are absent.

    A bracket that may hold more than ``bound`` rows is counted by ``_CELLS`` equal cells instead of by value, and the
    cells around the rank are the next round's bracket; so no task orders more than ``bound + _CELLS`` values per
    probability, at any size.  A rank that a bracket should miss is found in the next round as well."""
    spark, group_cols = df.sparkSession, list(group_cols or [])
    probs = sorted({float(p) for p in probs})
    ks = range(len(probs))
    group = [F.struct(*[F.col(c) for c in group_cols]).alias("_g")] if group_cols else []
    by = ["_g"] if group_cols else []
    vals = df.select(*group, F.col(value_col).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))

    near, wide = 2.0 / _SKETCH + 2.0 / _MIDDLE, 2.0 / _SKETCH + 2.0 / _SMALL
    grid = [_clip(p + s) for p in probs for s in (-wide, wide, -near, near)]
    n, q = F.col("n"), F.col("q")
    share = F.when(n < _SMALL, 1.0).when(n < _MIDDLE, 2 * wide).otherwise(2 * near)
    first = [F.when(n < _SMALL, F.col("least")).when(n < _MIDDLE, q[4 * k]).otherwise(q[4 * k + 2]).alias(f"lo{k}") for k in ks] + \
            [F.when(n < _SMALL, F.col("most")).when(n < _MIDDLE, q[4 * k + 1]).otherwise(q[4 * k + 3]).alias(f"hi{k}") for k in ks] + \
            [F.ceil(n * share).cast("long").alias(f"rows{k}") for k in ks]
    brackets = stored(vals.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"),
                                             F.percentile_approx("_v", grid, _SKETCH).alias("q"))
                       .where("n > 0").select(*by, "n", *first), "percentile-brackets")
    done = []
    for turn in range(_ROUNDS):
        found = stored(_located(vals, brackets, probs, by, bound if turn < _ROUNDS - 1 else None), "percentile-ranks")
        open_ = F.exists("at", lambda x: x["v0"].isNull() | x["v1"].isNull())
        done.append(found.where(~open_))
        rest = found.where(open_)
        if not rest.limit(1).count():
            break
        brackets = rest.select(*by, "n", *[F.get("at", F.lit(k))[f].alias(f"{f}{k}") for k in ks for f in ("lo", "hi", "rows")])
        if by:                                                        # only the groups that are not finished
            vals = vals.join(brackets.select("_g"), "_g", "left_semi")
    out = reduce(DataFrame.unionByName, done).select(*by, F.inline(F.transform("at", lambda x: F.struct(
        x["prob"].alias("prob"), (x["v0"] + (x["v1"] - x["v0"]) * x["frac"]).alias("value")))))
    return out.select(*[F.col(f"_g.{c}").alias(c) for c in group_cols], "prob", "value")


def _located(vals: DataFrame, brackets: DataFrame, probs: list[float], by: list[str], bound: int | None) -> DataFrame:
    """(group, n, at): per probability the values of both ranks where they are known, and the next bracket where not.

    One aggregate counts the values between the brackets and, inside them, by value or by cell.  Its rows hold disjoint
    ranges of values, so their order is that of their least values.  Without groups the bracket row comes in as literals."""
    ks = range(len(probs))
    if not by:
        row = brackets.first()
        if row is None:
            brackets = None
        else:
            literal = {c: F.lit(row[c]) for c in brackets.columns}

    def with_brackets(t: DataFrame) -> DataFrame:
        if by:
            return t.join(brackets, "_g")
        return t.withColumns(literal) if brackets is not None else t.limit(0).withColumns(
            {"n": F.lit(0).cast("long")} | {f"{f}{k}": F.lit(0).cast("long" if f == "rows" else "double") for k in ks for f in ("lo", "hi", "rows")})

    v = F.col("_v")
    inside = [(F.col(f"lo{k}") <= v) & (v <= F.col(f"hi{k}")) for k in ks]

    def label(k: int) -> Column:
        lo, hi = F.col(f"lo{k}") * 0.25, F.col(f"hi{k}") * 0.25       # a quarter: the width cannot overflow
        cell = F.floor((v * 0.25 - lo) / F.when(hi > lo, hi - lo) * _CELLS).cast("double")
        return v if bound is None else F.when(F.col(f"rows{k}") > bound, F.coalesce(cell, F.lit(0.0))).otherwise(v)

    above = sum((F.when(F.col(f"lo{k}") <= v, 1).otherwise(0) for k in ks), F.lit(0))
    counted = with_brackets(vals).select(*by, "_v", above.alias("i"), F.coalesce(*[F.when(c, F.lit(k)) for k, c in zip(ks, inside)]).alias("k"),
                                         F.coalesce(*[F.when(c, label(k)) for k, c in zip(ks, inside)]).alias("label")) \
        .groupBy(*by, "i", "k", "label").agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("mn"), F.max("_v").alias("mx"))
    line = Window.partitionBy(*by).orderBy("mn").rowsBetween(Window.unboundedPreceding, 0)
    t = with_brackets(counted.withColumn("to", F.sum("c").over(line)).withColumn("from", F.col("to") - F.col("c")))

    def holds(rank: Column) -> Column:
        here = (F.col("from") <= rank) & (rank < F.col("to"))
        known = F.when((F.col("mn") == F.col("mx")) | (rank == F.col("from")), F.col("mn")).when(rank == F.col("to") - 1, F.col("mx"))
        return F.max(F.when(here, F.struct("from", "to", "mn", "mx", known.alias("v"))))

    n = F.col("n")
    pos = [(n - 1).cast("double") * F.lit(p) for p in probs]
    r0 = [F.floor(x).cast("long") for x in pos]
    picks = [holds(r).alias(f"a{k}") for k, r in zip(ks, r0)] + [holds(F.least(r + 1, n - 1)).alias(f"b{k}") for k, r in zip(ks, r0)]
    out = t.groupBy(*by, "n").agg(*picks)
    at = [F.struct(F.lit(p).alias("prob"), (x - r).alias("frac"), F.col(f"a{k}.v").alias("v0"), F.col(f"b{k}.v").alias("v1"),
                   F.col(f"a{k}.mn").alias("lo"), F.col(f"b{k}.mx").alias("hi"), (F.col(f"b{k}.to") - F.col(f"a{k}.from")).alias("rows"))
          for k, p, x, r in zip(ks, probs, pos, r0)]
    return out.select(*by, "n", F.array(*at).alias("at"))


def percentiles_wide(df: DataFrame, value_col: str, probs: dict[str, float],
                     group_cols: list[str] | None = None) -> DataFrame:
    """One row per group with one column per named percentile."""
    group_cols = list(group_cols or [])
    long = exact_percentiles(df, value_col, list(probs.values()), group_cols)
    aggs = [F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("value"))).alias(name) for name, p in probs.items()]
    if group_cols:
        return long.groupBy(*group_cols).agg(*aggs)
    return long.agg(*aggs)


def approx_percentiles(df: DataFrame, value_col: str, probs: list[float], group_cols: list[str] | None = None,
                       accuracy: int = 10000) -> DataFrame:
    """Same long shape as ``exact_percentiles`` from a mergeable sketch
    (``percentile_approx``, rank error <= n / accuracy): one partial-aggregate
    pass and bounded memory per group.  For monitoring where an exact rank is
    not needed."""
    group_cols = list(group_cols or [])
    v = F.col(value_col).cast("double")
    vals = df.where(v.isNotNull() & ~F.isnan(v))
    q = F.percentile_approx(v, [float(p) for p in probs], accuracy).alias("_q")
    agg = vals.groupBy(*group_cols).agg(q) if group_cols else vals.agg(q)
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"), F.col("_q").alias("value"))
    return agg.where(F.col("_q").isNotNull()).select(*group_cols, F.inline(pairs))

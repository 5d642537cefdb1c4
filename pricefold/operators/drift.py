"""Drift between a reference and a current table (DRF-1, DRF-2, DRF-3, MET-12, SCH-4).

Plan: both tables are unpivoted to (feature, x), so all features share one
job.  Reference quantile edges come from the distributed exact percentile
(``ranking.exact_percentiles``).  The edges table has one row per feature; AQE
broadcasts it from its measured size.  Then ONE aggregate per side gives per-bucket
count / mean / variance, and PSI and the profiles are merged from those small
tables (at most features x (bins + 1) rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import exact_percentiles

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

# SCH-4 fixed values: preferred numeric feature names, in order
PREFERRED_NUMERIC = [
    "catalog_content_clean_len", "parsed_ounces", "parsed_value", "parsed_total_weight_g",
    "parsed_total_volume_ml", "parsed_total_count_units", "parsed_quantity_mentions",
    "parsed_has_quantity", "parsed_value_log1p", "parsed_weight_log1p", "parsed_volume_log1p",
    "parsed_count_log1p",
]


def numeric_columns(df: DataFrame, exclude: tuple = ("price",)) -> list[str]:
    ex = {e.lower() for e in exclude}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name.lower() not in ex]


def choose_numeric_features(df: DataFrame, target: str = "price") -> list[str]:
    """SCH-4: the preferred names that exist, else every numeric column but the target."""
    have = [c for c in PREFERRED_NUMERIC if c in df.columns]
    return have or numeric_columns(df, (target,))


def _long(df: DataFrame, cols: list[str]) -> DataFrame:
    return (df.select(*[F.col(c).cast("double").alias(c) for c in cols])
              .unpivot([], cols, "feature", "x")
              .where(F.col("x").isNotNull() & ~F.isnan("x")))


def _bucket_stats(df: DataFrame, cols: list[str], edges: DataFrame) -> DataFrame:
    """One pass over one side: per (feature, bucket) the row count, mean and
    population variance of the non-missing values (bucket is null for missing
    values).  Everything drift needs is merged from this small table."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "feature", "x")
    ok = F.col("x").isNotNull() & ~F.isnan("x")
    b = long.join(edges, "feature") \
        .withColumn("bucket", F.when(ok, F.size(F.filter("edges", lambda e: F.col("x") >= e)))) \
        .withColumn("xv", F.when(ok, F.col("x")))
    return b.groupBy("feature", "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("xv").alias("m"),
                                              F.var_pop("xv").alias("v"))


def _merge_profile(st: DataFrame, prefix: str) -> DataFrame:
    """Feature mean, population std (parallel-variance merge of the buckets) and
    missing rate from ``_bucket_stats``; the table has <= bins + 1 rows per feature."""
    w = Window.partitionBy("feature")
    okn = F.when(F.col("bucket").isNotNull(), F.col("n")).otherwise(0)
    # names differ from "n" by more than case: Spark resolves columns case-insensitively
    t = st.withColumn("okn", okn).withColumn("n_ok", F.sum("okn").over(w)).withColumn("n_all", F.sum("n").over(w))
    t = t.withColumn("mu", F.sum(F.col("okn") * F.coalesce(F.col("m"), F.lit(0.0))).over(w) / F.col("n_ok"))
    m2 = F.when(F.col("bucket").isNotNull(), F.col("n") * F.col("v") + F.col("n") * F.pow(F.col("m") - F.col("mu"), 2))
    return t.groupBy("feature").agg(
        F.first("mu").alias(f"{prefix}_mean"), F.sqrt(F.sum(m2) / F.first("n_ok")).alias(f"{prefix}_std"),
        ((F.first("n_all") - F.first("n_ok")) / F.first("n_all")).alias(f"missing_{prefix}"),
        F.first("n_ok").alias(f"{prefix}_n"))


def numeric_drift(ref: DataFrame, cur: DataFrame, cols: list[str] | None = None, bins: int = 10,
                  eps: float = 1e-9) -> DataFrame:
    """DRF-2: PSI and profiles for the numeric columns both tables share;
    a column empty on either side is skipped.  Passes: one rank pass over the
    reference (quantile edges) and one aggregate pass per side."""
    if cols is None:
        rc = numeric_columns(ref, ())
        cc = set(numeric_columns(cur, ()))
        cols = [c for c in rc if c in cc]
    probs = [i / bins for i in range(1, bins)]
    edges = (exact_percentiles(_long(ref, cols), "x", probs, ["feature"])
             .groupBy("feature")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("prob", "value"))), lambda s: s["value"])
                  .alias("edges")))
    rs, cs = _bucket_stats(ref, cols, edges), _bucket_stats(cur, cols, edges)
    pr, pc = _merge_profile(rs, "ref"), _merge_profile(cs, "cur")
    rb = rs.where(F.col("bucket").isNotNull()).select("feature", "bucket", F.col("n").alias("ref_cnt"))
    cb = cs.where(F.col("bucket").isNotNull()).select("feature", "bucket", F.col("n").alias("cur_cnt"))
    j = rb.join(cb, ["feature", "bucket"], "full_outer").join(pr, "feature").join(pc, "feature")
    r = F.greatest(F.coalesce(F.col("ref_cnt"), F.lit(0)) / F.greatest(F.col("ref_n"), F.lit(1)), F.lit(eps))
    c = F.greatest(F.coalesce(F.col("cur_cnt"), F.lit(0)) / F.greatest(F.col("cur_n"), F.lit(1)), F.lit(eps))
    out = j.groupBy("feature", "ref_mean", "cur_mean", "ref_std", "cur_std", "missing_ref", "missing_cur",
                    "ref_n", "cur_n").agg(F.sum((c - r) * F.log(c / r)).alias("psi"))
    out = out.where((F.col("ref_n") > 0) & (F.col("cur_n") > 0))
    return out.select("feature", "psi", "ref_mean", "cur_mean", "ref_std", "cur_std", "missing_ref", "missing_cur")


def baseline_drift(cur: DataFrame, baseline: dict[str, float], stats: dict, threshold: float = 0.15,
                   rel_limit: float = 0.05) -> DataFrame:
    """DRF-3 (re-aimed: the current statistics are computed from the table).
    ``stats`` maps a stat name to an aggregate Column; each is compared with its
    baseline by abs(cur - base) / (base + 1e-6)."""
    row = cur.agg(*[e.alias(k) for k, e in stats.items()])
    long = row.unpivot([], list(stats), "stat", "current")
    base = F.create_map(*[x for k, v in baseline.items() for x in (F.lit(k), F.lit(float(v)))])
    b = F.element_at(base, F.col("stat"))
    out = long.withColumn("baseline", b).withColumn("pct_change", F.abs(F.col("current") - b) / (b + 1e-6))
    out = out.withColumn("drifted", F.col("pct_change") > rel_limit)
    # one row per statistic, so the empty window is tiny
    score = F.max("pct_change").over(Window.partitionBy())
    return out.withColumn("drift_score", score).withColumn("alarm", score > threshold)

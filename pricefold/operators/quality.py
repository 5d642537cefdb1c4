"""Batch data-quality rules (DQ-1, DQ-2, FLT-3, FLT-4, MET-11).

All rules are evaluated in ONE aggregate pass; the per-rule results are then
unpivoted into issue rows (a table with at most #rules rows) and the policy
is a CASE over that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_BOUNDS = {"price": (0.0, 1_000_000.0), "Price": (0.0, 1_000_000.0)}
DEFAULT_REJECT_ON = ("missing_columns", "out_of_bounds")


def is_missing(df: DataFrame, col: str) -> Column:
    """pandas ``isna``: null, or NaN for floating columns."""
    c = F.col(col)
    if isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def out_of_bounds(col: str, lo: float, hi: float) -> Column:
    """FLT-3: text that is not a number becomes null and is never a violation."""
    v = F.col(col).cast("string").try_cast("double")
    return v.isNotNull() & ((v < lo) | (v > hi))


def needs_fallback(df: DataFrame, col: str) -> Column:
    """FLT-2: rows whose text or image is absent or blank; without the column, every row."""
    if col not in df.columns:
        return F.lit(True)
    return F.col(col).isNull() | (F.trim(F.col(col).cast("string")) == "")


def null_rates(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """MET-11: long (column_name, null_rate), one pass."""
    cols = cols or df.columns
    row = df.agg(*[F.avg(is_missing(df, c).cast("double")).alias(c) for c in cols])
    return row.unpivot([], cols, "column_name", "null_rate")


def validate_batch_quality(df: DataFrame, required_columns: list[str], max_null_rate: float = 0.4,
                           numeric_bounds: dict | None = None,
                           reject_on: tuple = DEFAULT_REJECT_ON) -> DataFrame:
    """DQ-1: issue rows (issue_type, column_name, observed, limit_lo, limit_hi)
    plus the batch ``policy`` (reject / quarantine / allow) and ``rows``.  A
    batch without issues gives one row with null issue fields."""
    bounds = DEFAULT_BOUNDS if numeric_bounds is None else numeric_bounds
    present = [c for c in required_columns if c in df.columns]
    missing = [c for c in required_columns if c not in df.columns]
    bcols = [c for c in bounds if c in df.columns]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.avg(is_missing(df, c).cast("double")).alias(f"nr__{c}") for c in present]
    aggs += [F.count_if(out_of_bounds(c, *bounds[c])).cast("double").alias(f"ob__{c}") for c in bcols]
    one = df.agg(*aggs)
    rule_rows = [F.struct(F.lit("high_null_rate").alias("issue_type"), F.lit(c).alias("column_name"),
                          F.col(f"nr__{c}").alias("observed"), F.lit(None).cast("double").alias("limit_lo"),
                          F.lit(float(max_null_rate)).alias("limit_hi"),
                          (F.col(f"nr__{c}") > max_null_rate).alias("hit")) for c in present]
    rule_rows += [F.struct(F.lit("out_of_bounds").alias("issue_type"), F.lit(c).alias("column_name"),
                           F.col(f"ob__{c}").alias("observed"), F.lit(float(bounds[c][0])).alias("limit_lo"),
                           F.lit(float(bounds[c][1])).alias("limit_hi"),
                           (F.col(f"ob__{c}") > 0).alias("hit")) for c in bcols]
    if missing:
        rule_rows.append(F.struct(F.lit("missing_columns").alias("issue_type"),
                                  F.lit(",".join(missing)).alias("column_name"),
                                  F.lit(float(len(missing))).alias("observed"),
                                  F.lit(None).cast("double").alias("limit_lo"),
                                  F.lit(None).cast("double").alias("limit_hi"), F.lit(True).alias("hit")))
    if not rule_rows:
        rule_rows.append(F.struct(F.lit(None).cast("string").alias("issue_type"),
                                  F.lit(None).cast("string").alias("column_name"),
                                  F.lit(None).cast("double").alias("observed"),
                                  F.lit(None).cast("double").alias("limit_lo"),
                                  F.lit(None).cast("double").alias("limit_hi"), F.lit(False).alias("hit")))
    rules = one.select("_rows", F.explode(F.array(*rule_rows)).alias("r")).select("_rows", "r.*")
    policy = (F.when(F.max(F.col("hit") & F.col("issue_type").isin(*reject_on)).over(Window.partitionBy()), "reject")
               .when(F.max(F.col("hit")).over(Window.partitionBy()), "quarantine").otherwise("allow"))
    # the rule table has one row per rule, so the empty window is tiny
    out = rules.withColumn("policy", policy)
    issues = out.where("hit")
    clean = out.where(~F.col("hit")).limit(1).where(F.col("policy") == "allow").select(
        F.col("_rows").alias("rows"), F.lit(None).cast("string").alias("issue_type"),
        F.lit(None).cast("string").alias("column_name"), F.lit(None).cast("double").alias("observed"),
        F.lit(None).cast("double").alias("limit_lo"), F.lit(None).cast("double").alias("limit_hi"), "policy")
    return issues.select(F.col("_rows").alias("rows"), "issue_type", "column_name", "observed", "limit_lo",
                         "limit_hi", "policy").unionByName(clean)


def route_rows(df: DataFrame, required_columns: list[str], numeric_bounds: dict | None = None) -> DataFrame:
    """DQ-2 (re-aimed to rows): ``reject`` when a bound is violated,
    ``quarantine`` when a required value is missing, else ``allow``."""
    bounds = DEFAULT_BOUNDS if numeric_bounds is None else numeric_bounds
    bad = [out_of_bounds(c, *bounds[c]) for c in bounds if c in df.columns]
    miss = [is_missing(df, c) for c in required_columns if c in df.columns]
    any_bad = F.lit(False)
    for b in bad:
        any_bad = any_bad | b
    any_miss = F.lit(False)
    for m in miss:
        any_miss = any_miss | m
    return df.withColumn("dq_route", F.when(any_bad, "reject").when(any_miss, "quarantine").otherwise("allow"))

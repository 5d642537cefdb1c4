"""Folds, samples and splits (SPL-*, SMP-*, WIN-4).

numpy's generator cannot be reproduced, so every draw is a hash of the row id
and the seed: ``md5(id || ':' || seed)``, first 8 hex digits as an unsigned
32-bit number.  DuckDB computes the same number, and any re-run or lost task
computes it again unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import exact_percentiles, rank_within

TWO_32 = 4294967296.0


def hash32(id_col, seed: int) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    h = F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def unit_draw(id_col, seed: int) -> Column:
    """Uniform draw in [0, 1) per id."""
    return hash32(id_col, seed).cast("double") / TWO_32


def kfold(df: DataFrame, id_col: str, n_splits: int = 5, seed: int = 42, fold_col: str = "fold") -> DataFrame:
    """SPL-1: shuffled K-fold; fold sizes are near equal."""
    return df.withColumn(fold_col, (hash32(id_col, seed) % n_splits).cast("int"))


def stratified_kfold(df: DataFrame, id_col: str, y_col: str, n_splits: int = 5, seed: int = 42,
                     fold_col: str = "fold") -> DataFrame:
    """SPL-2 + WIN-4: quantile bins of y (``min(10, max(2, k))`` bins, bin = number of
    inner edges strictly below y), then a round robin over each bin in hash order.
    Ranks inside a bin come from the range-partitioned ``rank_within``, so a bin
    never has to fit in one task."""
    n_bins = min(10, max(2, n_splits))
    inner = [i / n_bins for i in range(1, n_bins)]
    edges = exact_percentiles(df, y_col, inner).agg(
        F.array_sort(F.collect_list(F.struct("prob", "value"))).alias("e"))
    edge_vals = [r["value"] for r in (edges.first()["e"] or [])]
    y = F.col(y_col).cast("double")
    bin_col = sum((F.when(y > F.lit(e), 1).otherwise(0) for e in edge_vals), F.lit(0)) if edge_vals else F.lit(0)
    binned = df.withColumn("bin", bin_col.cast("int"))
    # only the keys are sorted and ranked; other columns come back by id
    ranked = rank_within(binned.select(id_col, "bin", hash32(id_col, seed).alias("_h")), ["_h", id_col], ["bin"], rank_col="_r") \
        .select(id_col, (F.col("_r") % n_splits).cast("int").alias(fold_col))
    return binned.join(ranked, id_col)


def exact_sample(df: DataFrame, id_col: str, frac: float | None = None, n: int | None = None,
                 seed: int = 42) -> DataFrame:
    """SMP-1/SMP-2: exactly round(frac * rows) (or ``n``) rows without replacement, the smallest by
    hash.  A bound on the hash keeps little more than the sample; only those rows are ranked."""
    total = df.count()
    n = int(round(frac * total)) if n is None else min(n, total)
    if n <= 0:
        return df.limit(0)
    keyed = df.withColumn("_h", hash32(id_col, seed))
    # hashes are uniform: the n smallest lie below this bound but for a chance of about 1e-9; then widen
    share = n / total
    bound = share + 6 * (share / total) ** 0.5 + 10 / total
    near = keyed.where(F.col("_h") < int(min(1.0, bound) * TWO_32))
    if near.count() < n:
        near = keyed
    return rank_within(near, ["_h", id_col], rank_col="_r").where(F.col("_r") < n).drop("_h", "_r")


def hash_split(df: DataFrame, id_col: str, test_frac: float = 0.2, seed: int = 42,
               col: str = "split") -> DataFrame:
    """SPL-3: train / test by a threshold on the hash draw."""
    return df.withColumn(col, F.when(unit_draw(id_col, seed) < test_frac, "test").otherwise("train"))


def canary_route(df: DataFrame, id_col: str, percent: float, seed: int = 7, col: str = "route") -> DataFrame:
    """SPL-4 (re-aimed from a per-request random draw): a stable hash bucket."""
    bucket = hash32(id_col, seed) % 10000
    return df.withColumn(col, F.when(bucket < F.lit(int(round(percent * 100))), "canary").otherwise("primary"))

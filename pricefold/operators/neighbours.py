"""Nearest-neighbour mutual information (SEL-2): the estimator of Kraskov, Stoegbauer and Grassberger (its first form).

``mi = psi(n) + psi(k) - mean(psi(n_x + 1) + psi(n_y + 1))``: the radius of a point is the largest-coordinate distance to its
``k``-th neighbour in (x, y), and n_x, n_y count the other points that lie nearer than that in one coordinate.  Coordinates are
divided by their standard deviation and put on a grid of ``2**-32``, so that all distances are whole numbers and a neighbour
at exactly the radius is never counted by rounding.

Points that are equal in both coordinates become one weighted point.  The points of a feature are dealt to strips of y and, within a
strip, to cells of x, by rank, so a cell holds at most ``CELL_ROWS`` points (a value of y that many rows share is one strip of many cells).
A cell gives each of its points the k nearest of the cell, which bounds the radius; points whose square reaches beyond their cell
are sent to the cells it touches (the nearest of every strip first), and the nearest of all answers are kept.  The counts are differences of distributed ranks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_dir
from .ranking import _rank_with_counts, rank_within

GRID = 2 ** 32
CELL_ROWS = 512
_FAR = 2 ** 62


def digamma(m: Column) -> Column:
    """psi of a whole number of at least 1: six steps of the recurrence, then the asymptotic series."""
    z = m.cast("double") + 6.0
    series = F.log(z) - 1 / (2 * z) - 1 / (12 * z ** 2) + 1 / (120 * z ** 4) - 1 / (252 * z ** 6) + 1 / (240 * z ** 8) \
        - 1 / (132 * z ** 10) + 691 / (32760 * z ** 12)
    return series - sum((1.0 / (m + i) for i in range(6)), F.lit(0.0))


def on_grid(long: DataFrame) -> DataFrame:
    """(idx, x, y) as whole numbers of ``std / GRID``; rows without a finite x and y are left out, a constant column is 0.  The
    deviation is taken to single precision and the shift to whole deviations, so that every engine gets the same grid."""
    rows = long.select("idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")) \
        .where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    st = rows.groupBy("idx").agg(*[f for c in "xy" for f in (
        F.avg(c).alias(f"_m{c}"), F.when(F.min(c) < F.max(c), F.stddev_pop(c)).cast("float").cast("double").alias(f"_s{c}"))])

    def scaled(c):
        s = F.col(f"_s{c}")
        return F.when(s > 0, F.floor((F.col(c) / s - F.floor(F.col(f"_m{c}") / s)) * GRID)).otherwise(F.lit(0)).cast("long").alias(c)
    return rows.join(st, "idx").select("idx", scaled("x"), scaled("y"))


def _cells(points: DataFrame, cell_rows: int) -> DataFrame:
    """Points with their strip of y, and their cell and bunch of cells by x.  Strips start at the values of y at every so many
    ranks; about as many bunches as cells in a bunch, so that no list of either grows with the rows."""
    by_y, n = _rank_with_counts(points, ["y", "x"], ["idx"], rank_col="_r")
    side = F.ceil(F.sqrt(F.col("_cnt") * float(cell_rows)))
    starts = by_y.join(n, "idx").where(F.col("_r") % side == 0).groupBy("idx").agg(F.collect_set("y").alias("_starts"))
    stripped = by_y.drop("_r").join(starts, "idx") \
        .withColumn("strip", F.size(F.filter("_starts", lambda v: v <= F.col("y"))).cast("long")).drop("_starts")
    by_x, n = _rank_with_counts(stripped, ["x", "y"], ["idx", "strip"], rank_col="_r")
    cells = F.ceil(F.col("_cnt") / cell_rows)
    return by_x.join(n, ["idx", "strip"]).withColumn("cell", F.floor(F.col("_r") * cells / F.col("_cnt"))) \
        .select("idx", "x", "y", "w", "strip", F.floor(F.col("cell") / F.ceil(F.sqrt(cells))).alias("bunch"), "cell")


def _kth(d: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of distances, the ``k`` nearest (distance, weight), nearest first; absent ones are far with weight 0."""
    take = min(k, d.shape[1])
    at = np.argpartition(d, take - 1, axis=1)[:, :take] if d.shape[1] > take else np.tile(np.arange(take), (len(d), 1))
    dist = np.take_along_axis(d, at, axis=1)
    order = np.argsort(dist, axis=1, kind="stable")
    at, dist = np.take_along_axis(at, order, axis=1), np.take_along_axis(dist, order, axis=1)
    weight = np.where(dist < _FAR, w[at], 0)
    pad = ((0, 0), (0, k - take))
    return np.pad(dist, pad, constant_values=_FAR), np.pad(weight, pad)


def _distances(ax, ay, bx, by) -> np.ndarray:
    return np.maximum(np.abs(ax[:, None] - bx[None, :]), np.abs(ay[:, None] - by[None, :]))


def _answer(points: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The nearest points of one cell to every query.  A point's own copies count, less the point itself (weight - 1 at 0)."""
    px, py, pw = points.x.to_numpy(), points.y.to_numpy(), points.w.to_numpy()
    parts = []
    for at in range(0, len(queries), CELL_ROWS):
        q = queries.iloc[at: at + CELL_ROWS]
        d = _distances(q.x.to_numpy(), q.y.to_numpy(), px, py)
        d[d == 0] = _FAR                                   # the point itself; its copies are added from its own weight
        dist, weight = _kth(d, pw, k)
        parts.append(pd.DataFrame({"idx": q.idx, "x": q.x, "y": q.y, "w": q.w, "dist": list(dist), "weight": list(weight)}))
    return pd.concat(parts) if parts else pd.DataFrame(columns=["idx", "x", "y", "w", "dist", "weight"])


def _radius(pairs: Column, w: Column, k: int) -> Column:
    """The distance at which the copies and the nearest points reach ``k``; far where there are fewer."""
    start = F.struct((w - 1).cast("long").alias("seen"), F.when(w > k, 0).otherwise(_FAR).cast("long").alias("r"))
    step = F.aggregate(F.array_sort(pairs), start, lambda a, p: F.struct(
        (a["seen"] + p["weight"]).alias("seen"),
        F.when((a["r"] == _FAR) & (a["seen"] + p["weight"] >= k), p["dist"]).otherwise(a["r"]).alias("r")))
    return step["r"]


_ANSWER = "idx int, x long, y long, w long, dist array<long>, weight array<long>"
_POINT = ["idx", "x", "y", "w"]
_CELL = ["idx", "strip", "bunch", "cell"]
_ASKED_ROWS = 50_000


def _boxes(celled: DataFrame, level: int, axis: str) -> DataFrame:
    """Per parent, the list of its children (strips, bunches or cells) with their extent on an axis."""
    keys = _CELL[: level + 1]
    return celled.groupBy(*keys).agg(F.min(axis).alias("lo"), F.max(axis).alias("hi")) \
        .groupBy(*keys[:-1]).agg(F.collect_list(F.struct("lo", "hi", keys[-1])).alias("_list"))


def _touched(points: DataFrame, celled: DataFrame, nearest: bool) -> DataFrame:
    """Points with the cells that their square (of side ``2 r``) reaches into, or only the nearest such one by x of every strip."""
    def near(axis):
        return lambda s: (s["hi"] > F.col(axis) - F.col("r")) & (s["lo"] < F.col(axis) + F.col("r"))

    out = points.where("r > 0")
    for level, axis in ((1, "y"), (2, "x"), (3, "x")):
        name = _CELL[level]
        found = F.filter("_list", near(axis))
        if nearest and level > 1:
            away = F.transform(found, lambda s: F.struct(F.greatest(s["lo"] - F.col("x"), F.col("x") - s["hi"], F.lit(0)).alias("d"), s[name].alias(name)))
            found = F.filter(F.array(F.array_min(away)), lambda s: s.isNotNull())
        out = out.join(_boxes(celled, level, axis), _CELL[:level]) \
            .withColumn(name, F.explode(F.transform(found, lambda s: s[name]))).drop("_list")
    return out


def _ask(asked: DataFrame, celled: DataFrame, k: int, folder: str) -> DataFrame:
    """The k nearest points of every asked cell.  A cell that many points ask for answers them in parts."""
    spark = asked.sparkSession
    asked.select(*_CELL, "x", "y", "w").write.parquet(folder)
    asked = spark.read.parquet(folder)
    parts = asked.groupBy(*_CELL).agg(F.ceil(F.count(F.lit(1)) / _ASKED_ROWS).alias("_parts"))
    keys = [*_CELL, "_part"]
    queries = asked.join(parts, _CELL).withColumn("_part", F.pmod(F.xxhash64("x", "y"), "_parts")).drop("_parts")
    rows = celled.join(parts, _CELL).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")

    def answers(key, q, p):
        return _answer(p, q, k)

    return queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(answers, _ANSWER)


def radii(points: DataFrame, k: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(idx, x, y, w, r): the distance from every weighted point to its k-th neighbour.  Three rounds: the own cell, then the nearest
    cell of every strip within that radius (a dense strip beside a thin one ends there), then all cells within the radius so far."""
    spark = points.sparkSession
    folder = scratch_dir(spark, "neighbour-cells")

    def kept(df, name):
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    pairs = F.arrays_zip("dist", "weight")
    celled = kept(_cells(points, cell_rows), "cells")
    own = celled.groupBy(*_CELL).applyInPandas(
        lambda key, rows: _answer(rows, rows, k).assign(strip=key[1], bunch=key[2], cell=key[3]), _ANSWER + ", strip long, bunch long, cell long")
    own = kept(own.select(*_CELL, "x", "y", "w", pairs.alias("p"), _radius(pairs, F.col("w"), k).alias("r")), "own")
    home = F.struct("strip", "bunch", "cell")
    start = own.select(*_POINT, "r", home.alias("_home"))
    first = _touched(start, celled, nearest=True).where(home != F.col("_home"))
    first = kept(first.select(*_CELL, "x", "y", "w"), "first-cells")
    found = kept(_ask(first, celled, k, folder + "/first-asked").select(*_POINT, pairs.alias("p")), "first")

    def merged(*answers):
        every = own.select(*_POINT, "p")
        for a in answers:
            every = every.unionByName(a)
        return every.groupBy(*_POINT).agg(F.flatten(F.collect_list("p")).alias("p")).select(*_POINT, _radius(F.col("p"), F.col("w"), k).alias("r"))

    start = merged(found).join(start.select(*_POINT, "_home"), _POINT)
    rest = _touched(start, celled, nearest=False).where(home != F.col("_home")).join(first, [*_CELL, "x", "y", "w"], "left_anti")
    more = _ask(rest, celled, k, folder + "/rest-asked").select(*_POINT, pairs.alias("p"))
    return merged(found, more)


def counts_nearer(points: DataFrame, radius: DataFrame) -> DataFrame:
    """(idx, x, y, w, n_x, n_y): the rows nearer than the radius in each coordinate, the row itself left out.  A radius of 0
    (more than k equal rows) counts the rows at the same coordinate."""
    reach = F.greatest(F.col("r"), F.lit(1))
    values = points.select("idx", "w", F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("v")) for c in "xy"])).alias("s")) \
        .select("idx", "s.axis", "s.v", "w").groupBy("idx", "axis", "v").agg(F.sum("w").alias("w"))
    ends = [F.struct(F.lit(c).alias("axis"), v.alias("v"), F.lit(sign).alias("sign"))
            for c in "xy" for v, sign in ((F.col(c) - reach + 1, -1), (F.col(c) + reach, 1))]
    asked = radius.select("idx", "x", "y", F.explode(F.array(*ends)).alias("s")).select("idx", "x", "y", "s.axis", "s.v", "s.sign")
    # rows below a value: the running weight over all asked and given values in order
    marks = values.unionByName(asked.select("idx", "axis", "v", F.lit(0).cast("long").alias("w"))).groupBy("idx", "axis", "v").agg(F.sum("w").alias("w"))
    below = running_weight(marks, ["idx", "axis"], "v", "w")
    got = asked.join(below, ["idx", "axis", "v"]).groupBy("idx", "x", "y").agg(*[
        F.sum(F.when(F.col("axis") == c, F.col("sign") * F.col("below"))).alias(f"n_{c}") for c in "xy"])
    return radius.join(got, ["idx", "x", "y"]).select("idx", "x", "y", "w", "r", *[(F.col(f"n_{c}") - 1).alias(f"n_{c}") for c in "xy"])


def running_weight(df: DataFrame, groups: list[str], order: str, weight: str, block_rows: int = 8192) -> DataFrame:
    """The weight before every row in its group's order (``below``): sums inside blocks of ranks, and of the blocks before."""
    ranked = rank_within(df, [order], groups, rank_col="_r").withColumn("_b", F.floor(F.col("_r") / block_rows))
    inside = Window.partitionBy(*groups, "_b").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    heads = ranked.groupBy(*groups, "_b").agg(F.sum(weight).alias("_w"))
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*groups, "_b", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_past"))
    out = ranked.withColumn("_in", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(heads, [*groups, "_b"])
    return out.select(*groups, order, (F.col("_in") + F.col("_past")).alias("below"))


def nearest_mutual_info(long: DataFrame, k: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(idx, n, mi) of every feature of ``long`` (idx, x, y); 0 where the estimate is negative, null for up to ``k`` rows."""
    points = on_grid(long).groupBy("idx", "x", "y").agg(F.count(F.lit(1)).alias("w"))
    spark = long.sparkSession
    folder = scratch_dir(spark, "neighbours")
    points.write.parquet(folder + "/points")
    points = spark.read.parquet(folder + "/points")
    radii(points, k, cell_rows).write.parquet(folder + "/radii")
    near = counts_nearer(points, spark.read.parquet(folder + "/radii"))
    total = near.groupBy("idx").agg(F.sum("w").alias("n"), F.sum(F.col("w") * (digamma(F.col("n_x") + 1) + digamma(F.col("n_y") + 1))).alias("s"))
    mi = digamma(F.col("n")) + digamma(F.lit(k)) - F.col("s") / F.col("n")
    return total.select("idx", "n", F.when(F.col("n") > k, F.greatest(mi, F.lit(0.0))).alias("mi"))

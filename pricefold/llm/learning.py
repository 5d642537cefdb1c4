"""Label handling shared by the two learned operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(id_col: str = "doc_id"):
    """crc32 of the id written as text, modulo 5; fold 0 is held out (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def training_labels(labels: DataFrame, label: str, bound: dict[int, int], id_col: str = "doc_id") -> DataFrame:
    """``(_id, y, fold)`` of the labelled rows outside fold 0, at most about ``bound[y]`` per class, drawn by a
    hash of the id.  Rows with a null id or label teach nothing; the first label by value counts for a
    repeated id."""
    rows = (labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("int").alias("y"),
                          fold(id_col).alias("fold"))
            .where("_id IS NOT NULL AND y IN (0, 1) AND fold <> 0")
            .groupBy("_id", "fold").agg(F.min("y").alias("y")))
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(1_000_000))
    keep = F.lit(False)
    for y, n in sizes.items():
        keep = keep | ((F.col("y") == y) & (draw < int(1_000_000 * min(1.0, bound[y] / max(1, n)))))
    return rows.where(keep)

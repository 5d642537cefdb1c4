"""Prediction post-processing (MTH-1 .. MTH-4) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log1p_clipped(c: Column) -> Column:
    """MTH-1 forward: log1p of the value clipped at 0."""
    return F.log1p(F.greatest(c, F.lit(0.0)))


def postprocess(pred: Column, inverse_log1p: bool = False, min_value: float | None = 0.0,
                round_cents: bool = True) -> Column:
    """MTH-4: optional expm1, clip to a minimum (MTH-2), round to cents with
    ties to even (MTH-3, numpy ``round``)."""
    out = F.expm1(pred) if inverse_log1p else pred
    if min_value is not None:
        out = F.greatest(out, F.lit(float(min_value)))
    if round_cents:
        out = F.bround(out, 2)
    return out

"""Row-wise ensembles of model prediction columns (ENS-3 .. ENS-10).

All are column expressions over a wide prediction row, so they run inside the
projection that produces them; no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def mean_of(cols) -> Column:
    """ENS-3 / ENS-7: plain mean."""
    cs = _cols(cols)
    return sum(cs[1:], cs[0]) / float(len(cs))


def weighted_sum(cols, weights) -> Column:
    """ENS-4: weights are not normalised."""
    cs = _cols(cols)
    return sum((c * float(w) for c, w in zip(cs[1:], weights[1:])), cs[0] * float(weights[0]))


def weighted_mean(cols, weights) -> Column:
    """ENS-7 / ENS-10: weights normalised to sum to one."""
    total = float(sum(weights))
    return weighted_sum(cols, [w / total for w in weights])


def max_of(cols) -> Column:
    return F.greatest(*_cols(cols))


def min_of(cols) -> Column:
    return F.least(*_cols(cols))


def median_of(cols) -> Column:
    """ENS-9: middle value; the mean of the two middle values for an even count."""
    n = len(cols)
    arr = F.array_sort(F.array(*_cols(cols)))
    if n % 2 == 1:
        return F.element_at(arr, n // 2 + 1)
    return (F.element_at(arr, n // 2) + F.element_at(arr, n // 2 + 1)) / 2.0


def vote_of(cols) -> Column:
    """ENS-6: majority vote over int-truncated predictions, ties to the
    smallest value; a negative prediction is an error."""
    arr = F.array(*[c.cast("long") for c in _cols(cols)])
    counts = F.transform(arr, lambda x: F.size(F.filter(arr, lambda y: y == x)))
    top = F.array_max(counts)
    winner = F.array_min(F.filter(arr, lambda x: F.size(F.filter(arr, lambda y: y == x)) == top))
    return F.when(F.array_min(arr) < 0, F.raise_error(F.lit("vote ensemble needs non-negative predictions"))) \
            .otherwise(winner)


def ensemble_predict(df: DataFrame, id_col: str, cols: list[str], method: str = "mean",
                     weights: list[float] | None = None, out_col: str = "price") -> DataFrame:
    """ENS-10: (id, price) from several prediction columns; missing weights are 1."""
    if method == "mean":
        pred = mean_of(cols)
    elif method == "weighted":
        w = list(weights or [])
        w = w + [1.0] * (len(cols) - len(w))
        pred = weighted_mean(cols, w)
    else:
        raise ValueError(method)
    return df.select(id_col, pred.alias(out_col))


def oof_matrix(long_preds: DataFrame, id_col: str, models: list[str], pred_col: str = "pred",
               model_col: str = "model") -> DataFrame:
    """JOI-1: long (id, model, pred) -> one column per model, keyed by id
    (replaces positional alignment); one shuffle on the id."""
    return long_preds.groupBy(id_col).pivot(model_col, models).agg(F.first(pred_col))

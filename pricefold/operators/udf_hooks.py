"""UDF-1: score with an outside model through an iterator pandas UDF.

The model is loaded once per task (not per row or per batch) and applied to
Arrow batches.  Use it only for models that Spark ML cannot express; the
input columns stay in Spark and only the needed columns cross to Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def external_scorer(loader: Callable[[], Callable[[pd.DataFrame], pd.Series]], input_cols: list[str]):
    """``loader()`` returns ``predict(pdf) -> Series``; it runs once per task."""
    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        predict = loader()
        for pdf in batches:
            yield predict(pdf).astype("float64")

    def apply(*cols: Column) -> Column:
        return score(F.struct(*[c.alias(n) for c, n in zip(cols, input_cols)]))

    return apply

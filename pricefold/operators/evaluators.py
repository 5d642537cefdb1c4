"""Spark ML evaluator for SMAPE (CV-4 model selection)."""

from __future__ import annotations

from pyspark.ml.evaluation import Evaluator
from pyspark.sql import functions as F

from .metrics import smape_term


class SmapeEvaluator(Evaluator):
    """Mean SMAPE in percent (lower is better); one aggregate per evaluation."""

    def __init__(self, labelCol: str = "label", predictionCol: str = "prediction", zero_policy: str = "floor"):
        super().__init__()
        self.labelCol, self.predictionCol, self.zero_policy = labelCol, predictionCol, zero_policy

    def _evaluate(self, dataset) -> float:
        term = smape_term(F.col(self.labelCol), F.col(self.predictionCol), self.zero_policy)
        return float(dataset.agg(F.avg(term)).first()[0])

    def isLargerBetter(self) -> bool:
        return False

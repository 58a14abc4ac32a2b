"""Scoring a stream with a fitted model.

The reference has no streaming; its scoring (B12, B13) is a pure column
expression, so the same expression applies to a streaming DataFrame
unchanged. Running confusion counts per micro-batch are a plain streaming
aggregate (state: six counters).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import svm as SVM


def score_stream(stream: DataFrame, weights, features: str = "features") -> DataFrame:
    """Margin and prediction for each arriving row."""
    return SVM.predict(stream, weights, features)


def running_confusion(stream: DataFrame, weights, features: str = "features",
                      label: str = "label") -> DataFrame:
    """Confusion counts over everything seen so far (complete output mode)."""
    scored = SVM.predict(stream, weights, features)
    pos = F.col("prediction") > F.lit(0.0)
    lab = F.col(label)
    return scored.agg(
        F.count_if(pos & (lab == F.lit(1.0))).alias("correct_pos"),
        F.count_if(~pos & (lab == F.lit(-1.0))).alias("correct_neg"),
        F.count_if(pos & ~(lab == F.lit(1.0))).alias("wrong_pos"),
        F.count_if(~pos & ~(lab == F.lit(-1.0))).alias("wrong_neg"))

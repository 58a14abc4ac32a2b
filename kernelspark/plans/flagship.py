"""The flagship query: train + evaluate, the reference's main program as
one Spark plan per step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import sampling as S
from ..operators import svm as SVM
from ..sources import tables as TB
from .common import C, LEARN_RATE, SEED, SPLIT, spread


def flagship(spark: SparkSession, sf_dir: str, solver: str = "newton",
             max_iter: int = 50, tol: float = 1e-9, tol_mode: str = "l1") -> DataFrame:
    """lineitem "charge" rows -> exact seeded 80/20 split -> squared-hinge SVM
    on train (C = 1) -> confusion on the hold-out.

    The default solver is finite Newton on the primal twin (same optimum,
    ~15 passes); ``solver="dual_ascent"`` runs the reference's projected
    dual ascent (learn rate 0.2, up to 500 iterations, one job each)."""
    rows = TB.lineitem_rows(spark, sf_dir)
    train, test = S.train_test_split(rows, SPLIT, SEED, list(TB.LINEITEM_KEYS))
    model = SVM.fit_svm(train, C=C, learn_rate=LEARN_RATE, max_iter=max_iter, tol=tol,
                        tol_mode=tol_mode, solver=solver, num_partitions=spread(spark))
    return SVM.evaluate(test, model.weights)

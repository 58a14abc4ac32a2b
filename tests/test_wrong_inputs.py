"""Inputs that must raise or stay whole instead of giving wrong rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_df
from kernelspark.functions import vectors as V
from kernelspark.operators import linalg as L
from kernelspark.operators import rows as RW
from kernelspark.operators import sampling as S
from kernelspark.operators import svm as SVM


def test_scale_rows_needs_exactly_one_weight(spark):
    df = rows_df(spark, [[float(i), 1.0] for i in range(10)])
    w = spark.createDataFrame([(i, 2.0) for i in range(10)], "row_id bigint, weight double")
    got = {r["row_id"]: list(r["features"]) for r in RW.scale_rows(df, w).collect()}
    assert got == {i: [2.0 * i, 2.0] for i in range(10)}
    for bad in (w.withColumn("row_id", F.col("row_id") + 5), w.union(w.limit(1)),
                w.withColumn("weight", F.when(F.col("row_id") > 0, F.col("weight")))):
        with pytest.raises(Exception, match="weights for row"):
            RW.scale_rows(df, bad).collect()


@pytest.mark.parametrize("solver", ["newton", "dual_ascent"])
def test_svm_refuses_bad_labels_and_entries(spark, solver):
    X = np.random.default_rng(0).normal(size=(30, 2))
    y = np.where(X[:, 0] > 0, 1.0, -1.0)
    good = rows_df(spark, X, y)
    zero_one = rows_df(spark, X, (y + 1) / 2)
    null_label = good.withColumn("label", F.when(F.col("row_id") != 3, F.col("label")))
    nan = good.withColumn("features", F.when(F.col("row_id") == 3, F.array(F.lit(float("nan")), F.lit(1.0))).otherwise(F.col("features")))
    null_entry = good.withColumn("features", F.when(F.col("row_id") == 3, F.array(F.lit(None), F.lit(1.0))).otherwise(F.col("features")))
    for bad, what in ((zero_one, "label"), (null_label, "label"), (nan, "NaN"), (null_entry, "NaN")):
        with pytest.raises(ValueError, match=what):
            SVM.fit_svm(bad, solver=solver, max_iter=2)


def test_svd_and_thin_q_of_dependent_columns(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(1800, 3))
    X = np.hstack([X, X[:, :1], X[:, 1:2] + X[:, 2:3]])
    df = rows_df(spark, X, parts=5)
    svd = L.truncated_svd(df)
    assert len(svd.s) == 3 and np.allclose(svd.s, np.linalg.svd(X, compute_uv=False)[:3])
    U = np.array([r["u"] for r in svd.U.orderBy("row_id").collect()])
    assert np.abs(U.T @ U - np.eye(3)).max() < 1e-9 and np.allclose(U * svd.s @ svd.V.T, X)
    with pytest.raises(ValueError, match="singular"):
        L.thin_q(df, L.tsqr_r(df))
    full = rows_df(spark, X[:, :3], parts=5)
    R = L.tsqr_r(full)
    for refine in (False, True):
        Q, R2 = L.thin_q(full, R, refine=refine)
        q = np.array([r["q"] for r in Q.orderBy("row_id").collect()])
        assert np.abs(q.T @ q - np.eye(3)).max() < 1e-9 and np.allclose(q @ R2, X[:, :3])


def test_global_rank_puts_nulls_first(spark):
    df = spark.createDataFrame([(None if i % 7 == 0 else i % 11, i) for i in range(1801)], "k bigint, id bigint")
    got = S.global_rank(df, ["k", "id"], "pos", num_partitions=9).collect()
    want = sorted(((r["k"] is not None, r["k"] or 0, r["id"]) for r in got))
    assert [r["id"] for r in sorted(got, key=lambda r: r["pos"])] == [w[2] for w in want]


def test_one_width_rule(spark):
    for d in (3, 128, 129, 200):
        df = spark.createDataFrame([([1.0] * d,)], "x array<double>")
        assert df.select(V.dot_const("x", [1.0] * d).alias("s")).first()["s"] == d
        for w in (d - 1, d + 1):
            with pytest.raises(Exception, match="not of width"):
                df.select(V.dot_const("x", [1.0] * w)).collect()
        with pytest.raises(Exception, match="not of width"):
            df.select(V.sqdist_const("x", [1.0] * (d + 1))).collect()
    nan = spark.createDataFrame([([float("nan"), 1.0],)], "x array<double>")
    assert np.isnan(nan.select(V.dot_const("x", [0.0, 1.0]).alias("s")).first()["s"])


def test_permutation_within_groups_and_splits(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 != 0, F.col("id") % 5).alias("g"))
    got = S.random_permutation(df, 7, ["id"], by="g").collect()
    for g in {r["g"] for r in got}:
        pos = sorted(r["perm_pos"] for r in got if r["g"] == g)
        assert pos == list(range(len(pos)))
    pos = [r["perm_pos"] for r in S.random_permutation(df.repartition(3), 7, ["id"]).collect()]
    assert sorted(pos) == list(range(4000))
    for fraction, n in ((0.0, 0), (0.25, 1000), (1.0, 4000)):
        train, test = S.train_test_split(df, fraction, 7, ["id"])
        assert (train.count(), test.count()) == (n, 4000 - n)
    assert S.train_test_split(df.limit(0), 0.5, 7, ["id"])[0].count() == 0

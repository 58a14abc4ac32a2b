import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_df
from kernelspark.operators import aggregates as A
from kernelspark.operators import svm as SVM


def _blobs(n=400, seed=0):
    rng = np.random.default_rng(seed)
    y = np.where(rng.random(n) < 0.6, 1.0, -1.0)
    X = rng.normal(size=(n, 3)) + y[:, None] * np.array([1.0, 0.5, 0.0])
    return X, y


def _numpy_dual(X, y, C, lr, k):
    A_ = y[:, None] * np.hstack([X, np.ones((len(X), 1))])
    H = A_ @ A_.T + np.eye(len(X)) / (2 * C)
    step = SVM.step_size(C, lr)
    beta = np.ones(len(X))
    hist = []
    for _ in range(k):
        alpha = np.linalg.solve(H, 1 + beta)
        nb = np.maximum(beta - step * alpha, 0)
        hist.append(np.abs(nb - beta).sum())
        beta = nb
    return A_.T @ alpha, hist


def _primal_opt(X, y, C):
    A_ = y[:, None] * np.hstack([X, np.ones((len(X), 1))])
    w = np.zeros(A_.shape[1])
    for _ in range(100):
        r = 1 - A_ @ w
        act = r > 0
        g = w - 2 * C * A_[act].T @ r[act]
        H = np.eye(len(w)) + 2 * C * A_[act].T @ A_[act]
        w = w - np.linalg.solve(H, g)
    return w


def test_step_size_rules():
    assert abs(SVM.step_size(1.0, 0.2) - 0.9) < 1e-12
    with pytest.raises(ValueError):
        SVM.step_size(1.0, 1.5)


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_dual_ascent_matches_dense_solve(spark, parts):
    X, y = _blobs()
    m = SVM.fit_svm(rows_df(spark, X, y, parts=parts), max_iter=5, tol=0.0, num_partitions=parts,
                    checkpoint_every=2)
    w_np, hist = _numpy_dual(X, y, 1.0, 0.2, 5)
    assert np.allclose(m.weights, w_np, atol=1e-8)
    assert np.allclose([e for _, e in m.history_rows], hist, rtol=1e-8)


def test_dual_converges_to_newton_optimum_with_checkpoints(spark):
    X, y = _blobs(200, 1)
    df = rows_df(spark, X, y, parts=3)
    m = SVM.fit_svm(df, max_iter=400, tol=1e-7, checkpoint_every=10)
    nt = SVM.fit_svm(df, solver="newton", max_iter=50, tol=1e-10)
    w = _primal_opt(X, y, 1.0)
    assert m.converged and nt.converged
    assert np.allclose(nt.weights, w, atol=1e-8)
    assert np.allclose(m.weights, w, atol=1e-4)
    kkt = SVM.kkt_report(m.state, df, m.weights, 1.0).first()
    assert kkt["max_alpha_gap"] < 1e-3 and kkt["min_beta"] >= 0.0
    rows = df.withColumn("label", F.col("label"))
    b = SVM.weights_from_alpha(rows.join(m.state.select("row_id", "alpha"), "row_id"))
    assert np.allclose(b, m.weights, atol=1e-6)


def test_predict_tie_is_negative_and_confusion(spark):
    df = spark.createDataFrame([(0, [1.0], 1.0), (1, [-1.0], -1.0), (2, [0.0], 1.0), (3, [2.0], 3.0)],
                               "row_id bigint, features array<double>, label double")
    out = {r["row_id"]: r["prediction"] for r in SVM.predict(df, [1.0, 0.0]).collect()}
    assert out == {0: 1.0, 1: -1.0, 2: -1.0, 3: 1.0}
    c = SVM.evaluate(df, [1.0, 0.0]).first()
    assert (c["correct"], c["wrong"], c["wrong_neg"], c["wrong_pos"]) == (2, 2, 1, 1)
    assert c["accuracy"] == 50.0


def test_one_class_and_width_errors(spark):
    X = np.random.default_rng(3).normal(size=(50, 2))
    m = SVM.fit_svm(rows_df(spark, X, np.ones(50)), solver="newton", tol=1e-9)
    assert m.weights[-1] > 0          # everything is predicted positive
    bad = spark.createDataFrame([(0, [1.0, 2.0], 1.0), (1, [1.0], -1.0)],
                                "row_id bigint, features array<double>, label double")
    with pytest.raises(ValueError):
        SVM.fit_svm(bad, max_iter=2)


def test_bias_from_support(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1.0, 0.5), (1, [0.0, 1.0], -1.0, 0.25),
                                (2, [1.0, 1.0], 1.0, 0.0)],
                               "row_id bigint, features array<double>, label double, alpha double")
    r = A.bias_from_support(df).first()
    assert r["n_support"] == 2 and abs(r["bias"] - (1.0 - 0.5)) < 1e-12


def test_wide_design_uses_arrow_partials(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(300, 20))
    y = np.where(X[:, 0] + 0.3 * rng.normal(size=300) > 0, 1.0, -1.0)
    df = rows_df(spark, X, y, parts=4)
    nt = SVM.fit_svm(df, solver="newton", max_iter=50, tol=1e-10)
    assert nt.converged and np.allclose(nt.weights, _primal_opt(X, y, 1.0), atol=1e-7)
    m = SVM.fit_svm(df, max_iter=4, tol=0.0)
    w_np, hist = _numpy_dual(X, y, 1.0, 0.2, 4)
    assert np.allclose(m.weights, w_np, atol=1e-8)


def test_a_killed_fit_goes_on(spark, tmpdir_path, monkeypatch):
    """Killed after step 7 and in the middle of a checkpoint: the same iterates; checkpoints hold beta alone."""
    import glob
    import os
    from kernelspark.operators import dual as D
    X, y = _blobs(300, 2)
    df = rows_df(spark, X, y, parts=3)
    whole = SVM.fit_svm(df, max_iter=12, tol=0.0, checkpoint_every=3)
    folder, real, done = f"{tmpdir_path}/run", D._sums, []

    def dies(*a):
        if len(done) == 7:
            raise KeyboardInterrupt
        done.append(1)
        return real(*a)

    monkeypatch.setattr(D, "_sums", dies)
    with pytest.raises(KeyboardInterrupt):
        SVM.fit_svm(df, max_iter=12, tol=0.0, checkpoint_every=3, resume_dir=folder)
    monkeypatch.setattr(D, "_sums", real)
    assert len(glob.glob(f"{folder}/step-*")) == 7 and os.path.exists(f"{folder}/beta-000006.done")
    os.mkdir(f"{folder}/beta-000009")           # a checkpoint that was not finished
    with open(f"{folder}/step-000099.tmp", "w") as f:
        f.write("{")
    m = SVM.fit_svm(df, max_iter=12, tol=0.0, checkpoint_every=3, resume_dir=folder)
    assert m.weights_path == whole.weights_path and m.history_rows == whole.history_rows
    assert sorted(m.state.collect()) == sorted(whole.state.collect())
    again = SVM.fit_svm(df, max_iter=12, tol=0.0, checkpoint_every=3, resume_dir=folder)      # nothing left to do
    assert again.weights == m.weights and sorted(again.state.collect()) == sorted(m.state.collect())
    assert spark.read.parquet(f"{folder}/beta-000009").columns == ["block", "beta"]
    with pytest.raises(ValueError):
        SVM.fit_svm(df, C=0.5, max_iter=12, tol=0.0, resume_dir=folder)


def test_checkpoint_bytes_do_not_depend_on_the_width(spark, tmpdir_path):
    sizes = {}
    for d in (2, 40):
        rng = np.random.default_rng(d)
        X = rng.normal(size=(500, d))
        SVM.fit_svm(rows_df(spark, X, np.sign(X[:, 0]), parts=2), max_iter=4, tol=0.0, checkpoint_every=2, resume_dir=f"{tmpdir_path}/{d}")
        rows = spark.read.parquet(f"{tmpdir_path}/{d}/beta-000002").selectExpr("sum(octet_length(beta))").first()
        sizes[d] = rows[0]
    assert sizes[2] == sizes[40] == 8 * 500

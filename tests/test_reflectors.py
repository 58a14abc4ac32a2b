"""Products with Q by reflectors, rank decision."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_df
from kernelspark.operators import linalg as L
from kernelspark.operators import reflectors as H


def singular(n=600, seed=0):
    """Dependent, repeated, zero and badly scaled columns."""
    x = np.random.default_rng(seed).normal(size=(n, 7))
    x[:, 3] = x[:, 0]
    x[:, 4] = 2 * x[:, 1] - x[:, 2]
    x[:, 5] = 0.0
    x[:, 6] *= 1e-12
    return x


@pytest.mark.parametrize("n", [1, 3, 7, 50])
def test_block(n):
    m = np.random.default_rng(n).normal(size=(n, 7))
    v, t, r = H.block_qr(m)
    q = np.eye(n) - v @ t @ v.T
    assert np.allclose(q @ q.T, np.eye(n), atol=1e-13)
    assert np.allclose((q.T @ m)[:len(r)], r) and np.allclose((q.T @ m)[len(r):], 0)
    x = np.arange(n, dtype=float)
    assert np.allclose(H.turn(v, t, x, True), q.T @ x) and np.allclose(H.turn(v, t, x, False), q @ x)


@pytest.mark.parametrize("parts,block,fan", [(1, 4096, 32), (4, 20, 2), (7, 3, 3), (5, 1, 4)])
def test_products_of_a_singular_matrix(spark, parts, block, fan):
    x = singular()
    y = np.sin(np.arange(len(x))) + 2
    f = H.factor(rows_df(spark, x, y, parts), keep=("row_id", "label"), block_rows=block, fan=fan)
    assert np.allclose(f.r.T @ f.r, x.T @ x, rtol=1e-10, atol=1e-10)
    sizes = [max(len(r.ck) for r in t.collect()) for t in f.levels]
    assert max(sizes) <= fan and (len(f.levels) > 1) == (block < 4096)
    c = H.qt(f, "label")
    assert abs(c.norm_sq() / (y @ y) - 1) < 1e-12
    back = {r.row_id: r for r in H.q(f, c, "back").collect()}
    assert len(back) == len(x) and max(abs(back[i].back - y[i]) for i in back) < 1e-12
    assert all(back[i].label == y[i] for i in back)
    # R^T c = A^T x holds whatever the rank
    assert np.allclose(f.r.T @ c.top, x.T @ y, atol=1e-9)
    e = np.zeros(7)
    e[1] = 1.0
    col = np.array([r.x for r in H.thin_rows(f, e).orderBy("row_id").collect()])
    assert abs(col @ col - 1) < 1e-12
    with pytest.raises(ValueError):
        L.thin_q(rows_df(spark, x), f.r)
    c.drop()
    f.drop()


def test_projection_by_rank(spark):
    """The pivots' columns span the range: projecting a column of A gives it back."""
    x = singular()[:, [0, 1, 2, 4, 3]]
    f = H.factor(rows_df(spark, x, x[:, 3], 3), keep=("row_id", "label"), block_rows=100)
    p = H.pivoted_r(f.r)
    assert p.rank == 3
    c = H.qt(f, "label").top
    fit = [r.x for r in H.thin_rows(f, c[:3]).orderBy("row_id").collect()]
    assert np.allclose(fit, x[:, 3], atol=1e-12)


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_rank_decision_same_for_any_partitioning(spark, parts):
    x = singular()
    want = H.pivoted_r(np.linalg.qr(x, mode="r"))
    got = H.pivoted_r(L.tsqr_r(rows_df(spark, x, parts=parts)))
    assert got.order == want.order and got.rank == want.rank == 3
    assert np.allclose(got.r, want.r, atol=1e-9)
    assert np.allclose(got.r.T @ got.r, (x.T @ x)[np.ix_(got.order, got.order)], atol=1e-8)
    assert got.order.index(0) < got.order.index(3)


def test_tournament_of_panels():
    r = np.random.default_rng(5)
    for rank in (1, 4, 9, 24):
        x = r.normal(size=(60, rank)) @ r.normal(size=(rank, 24)) * np.logspace(0, -3, 24)
        for panel in (1, 2, 5, 64):
            p = H.pivoted_r(np.linalg.qr(x, mode="r"), panel=panel)
            assert p.rank == rank and sorted(p.order) == list(range(24))
            assert np.allclose(p.r.T @ p.r, (x.T @ x)[np.ix_(p.order, p.order)], atol=1e-9)
            assert np.all(np.abs(np.diag(p.r)) > 0)
    one = H.pivoted_r(np.diag([1.0, 5.0, 3.0]), zero_tol=2.0)
    assert one.order == [1, 2, 0] and one.rank == 3 and one.r[2, 2] == 0.0
    assert H.pivoted_r(np.zeros((3, 3))).rank == 0


def test_wrong_inputs(spark):
    df = rows_df(spark, np.ones((3, 2)), np.ones(3))
    f = H.factor(df, keep=("row_id", "label"))
    with pytest.raises(ValueError):
        H.qt(f, "other")
    with pytest.raises(ValueError):
        H.q(f, H.qt(f, "label"), "row_id")
    with pytest.raises(ValueError):
        H.factor(df.limit(0))
    with pytest.raises(Exception):
        H.factor(df.withColumn("features", F.when(F.col("row_id") > 0, F.col("features"))))

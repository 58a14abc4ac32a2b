import numpy as np
import pytest

from conftest import rows_df
from kernelspark.operators import linalg as L
from pyspark.sql import functions as F


def _data(n=300, d=4, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + 0.5


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_tsqr_matches_numpy_any_partitioning(spark, parts):
    X = _data()
    R = L.tsqr_r(rows_df(spark, X, parts=parts), "features", 4)
    R_np = np.linalg.qr(X, mode="r")
    assert np.allclose(R, L.canonical_r(R_np), atol=1e-9)
    assert np.all(np.diag(R) >= 0)


def test_tsqr_tree_reduction(spark):
    X = _data(500, 3, 1)
    R = L.tsqr_r(rows_df(spark, X, parts=40), "features", 3, fan=4)
    assert np.allclose(R.T @ R, X.T @ X, rtol=1e-10)


def test_gram_sql_and_arrow(spark):
    X = _data(200, 5, 2)
    df = rows_df(spark, X, parts=3)
    for method in ("sql", "arrow"):
        G = L.cells_to_matrix(L.gram(df, "features", 5, method=method), 5)
        assert np.allclose(G, X.T @ X)


def test_thin_q_and_apply_q_roundtrip(spark):
    X = _data(150, 3, 3)
    y = np.sin(np.arange(150))
    df = rows_df(spark, X, y, parts=5).withColumn("x", F.col("label"))
    R = L.tsqr_r(df, "features", 3)
    Q, _ = L.thin_q(df, R, "features", "q")
    assert np.allclose(L.gram_matrix(Q, "q", 3), np.eye(3), atol=1e-10)
    qt = L.apply_qt(df, R, "features", "x", keep=("row_id", "features", "x"))
    Qn, _ = np.linalg.qr(X)
    assert np.allclose(np.abs(qt.c), np.abs(Qn.T @ y), atol=1e-9)
    rsq = qt.residual.agg(F.sum(F.col("residual") ** 2)).first()[0]
    assert abs(rsq + qt.c @ qt.c - y @ y) < 1e-8
    back = L.apply_q(qt.residual, R, qt.c, "features", "residual", "xb", keep=("row_id", "x"))
    assert back.filter(F.abs(F.col("xb") - F.col("x")) > 1e-9).count() == 0


def test_truncated_svd_against_numpy(spark):
    X = _data(120, 4, 4)
    svd = L.truncated_svd(rows_df(spark, X, parts=3), k=3, keep=("row_id",))
    s_np = np.linalg.svd(X, compute_uv=False)
    assert np.allclose(svd.s, s_np[:3])
    U = np.array([r["u"] for r in svd.U.orderBy("row_id").collect()])
    assert np.allclose(U.T @ U, np.eye(3), atol=1e-8)


def test_edge_cases_rank_deficient_and_wide(spark):
    X = _data(50, 3, 5)
    Xd = np.hstack([X, X[:, :1], np.zeros((50, 1))])      # duplicate + zero column
    R = L.tsqr_r(rows_df(spark, Xd, parts=4), "features", 5)
    assert np.allclose(R.T @ R, Xd.T @ Xd, atol=1e-8)
    Xw = _data(3, 6, 6)                                      # fewer rows than columns
    Rw = L.tsqr_r(rows_df(spark, Xw, parts=8), "features", 6)  # and empty partitions
    assert Rw.shape == (6, 6) and np.allclose(Rw.T @ Rw, Xw.T @ Xw, atol=1e-8)


def test_group_svd(spark):
    rng = np.random.default_rng(7)
    cells = []
    mats = {}
    for g in range(3):
        A = rng.normal(size=(4, 4))
        mats[g] = A
        cells += [(g, i, j, float(A[i, j])) for i in range(4) for j in range(4)]
    df = spark.createDataFrame(cells, "g int, i int, j int, value double")
    out = L.group_svd(df, "g").collect()
    for g, A in mats.items():
        s = sorted([r["s"] for r in out if r["g"] == g], reverse=True)
        assert np.allclose(s, np.linalg.svd(A, compute_uv=False))


def test_width_mismatch_raises(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1.0), (1, [1.0], -1.0)],
                               "row_id bigint, features array<double>, label double")
    with pytest.raises(Exception):
        L.cells_to_matrix(L.gram(df, "features", 2, method="arrow"), 2)


def test_two_level_sums_match_one_level(spark):
    from kernelspark.operators import aggregates as A
    df = spark.range(0, 1000, numPartitions=12).select((F.col("id") * 0.5).alias("x"))
    one = A.collect_sums(df, {"s": "x", "q": F.col("x") * F.col("x")})
    two = A.collect_sums(df, {"s": "x", "q": F.col("x") * F.col("x")}, fan=4)
    assert one == two and one["s"] == 0.5 * 999 * 1000 / 2


def test_merges_have_a_fixed_fan_in(spark):
    """Many tiny partitions: no group holds more than the fan, wide and narrow sums agree."""
    from kernelspark.operators import aggregates as A
    n, width = 700, 12
    blocks = spark.range(n).selectExpr("CAST(id AS INT) AS p", f"transform(sequence(1, {width}), j -> CAST(id * j AS DOUBLE)) AS v")
    want = np.arange(1, width + 1) * (n * (n - 1) / 2.0)
    assert np.array_equal(A.collect_block_sum(blocks, width), want)
    flat, A.FLAT_CELLS = A.FLAT_CELLS, 4
    try:
        assert np.array_equal(A.collect_block_sum(blocks, width, fan=4), want)
    finally:
        A.FLAT_CELLS = flat

    def meet(pdf):
        import pandas as pd
        return pd.DataFrame({"most": [max(len(pdf), int(pdf["most"].max()))], "rows": [int(pdf["rows"].sum())]})

    ones = spark.range(n).selectExpr("CAST(id AS INT) AS p", "CAST(0 AS BIGINT) AS most", "CAST(1 AS BIGINT) AS rows")
    got = A.tree_levels(ones, "p", "p int, most long, rows long", meet, fan=4).collect()
    assert len(got) <= 4 and max(r.most for r in got) == 4 and sum(r.rows for r in got) == n
    assert A.tree_levels(ones.limit(0), "p", "p int, most long, rows long", meet).count() == 0


def test_tsqr_of_many_partitions(spark):
    X = _data(900, 3, 8)
    R = L.tsqr_r(rows_df(spark, X, parts=300), "features", 3, fan=4)
    assert np.allclose(R, L.canonical_r(np.linalg.qr(X, mode="r")), atol=1e-9)

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_df
from kernelspark.operators import aggregates as A
from kernelspark.operators import cluster as CL
from kernelspark.operators import nystrom as NY
from kernelspark.plans import meka as MK


def _clustered(n=240, seed=0):
    rng = np.random.default_rng(seed)
    centers = np.array([[0, 0, 0], [4, 0, 0], [0, 4, 0], [0, 0, 4]], dtype=float)
    lab = rng.integers(0, 4, n)
    return centers[lab] + 0.5 * rng.normal(size=(n, 3)), lab


def test_assign_ties_to_lower_index_and_lloyd(spark):
    df = rows_df(spark, [[0.0, 0.0], [2.0, 0.0], [5.0, 0.0]])
    out = {r["row_id"]: r["cluster"] for r in
           CL.assign_clusters(df, [[1.0, 0.0], [3.0, 0.0]]).collect()}
    assert out == {0: 0, 1: 0, 2: 1}        # row 1 is equally far: lower index
    new = {r["cluster"]: r["center"] for r in CL.lloyd_step(df, [[1.0, 0.0], [3.0, 0.0]]).collect()}
    assert np.allclose(new[0], [1.0, 0.0]) and np.allclose(new[1], [5.0, 0.0])


def test_rank_allocation_rules(spark):
    sizes = spark.createDataFrame([(0, 10), (1, 30), (2, 60)], "cluster int, n bigint")
    r = {x["cluster"]: (x["rank"], x["col_offset"]) for x in CL.rank_allocation(sizes, 10).collect()}
    # ceil(1.0)=1, ceil(3.0)=3, ceil(6.0)=6 -> sum 10, offsets 0, 1, 4
    assert r == {0: (1, 0), 1: (3, 1), 2: (6, 4)}
    r = {x["cluster"]: x["rank"] for x in CL.rank_allocation(sizes, 8).collect()}
    # ceil(0.8)=1, ceil(2.4)=3, ceil(4.8)=5 -> surplus 1 off the last
    assert r == {0: 1, 1: 3, 2: 4}
    tiny = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, 1)], "cluster int, n bigint")
    with pytest.raises(Exception):
        CL.rank_allocation(tiny, 2).collect()    # the last cluster would get rank < 1


def test_link_threshold(spark):
    c = np.array([[0.0], [1.0], [3.0]])
    thr, mm = CL.link_threshold(c, 1.0, 0.5)
    K = np.exp(-(c - c.T) ** 2)
    assert mm == 3 and thr == np.sort(K.ravel())[2]
    assert CL.link_threshold(c, 1.0, 0.0) == (0.0, 0)


def test_nystrom_exact_when_rank_covers_cluster(spark):
    X, lab = _clustered(60, 1)
    df = rows_df(spark, X).withColumn("cluster", F.lit(0))
    ranks = spark.createDataFrame([(0, 60, 60, 0)], "cluster int, n bigint, rank int, col_offset int")
    feats = NY.nystrom_features(df, ranks, 0.5, 1, rcond=1e-12)
    U = np.array([r["u"] for r in feats.orderBy("row_id").collect()])
    K = CL.rbf_matrix(X, X, 0.5)
    assert np.abs(U @ U.T - K).max() < 1e-5


def test_meka_approximates_kernel_with_positive_power(spark):
    X, lab = _clustered(240, 2)
    df = rows_df(spark, X, np.where(lab == 0, 1.0, -1.0), parts=4)
    mk = MK.meka_features(df, n_clusters=4, target_rank=40, gamma=0.2, eta=0.1, seed=3,
                          link_power=0.5)
    phi = np.array([r["features"] for r in mk.features.orderBy("row_id").collect()])
    K = CL.rbf_matrix(X, X, 0.2)
    assert phi.shape == (240, 40)
    assert np.abs(phi @ phi.T - K).mean() < 0.05
    err = MK.approximation_error(mk, df, 0.2, 3, n_pairs=50).first()
    assert err["n_pairs"] == 50 and err["mean_abs_error"] < 0.1
    ds = MK.meka_dataset(df, n_clusters=4, target_rank=40, gamma=0.2, split=0.75, seed=3,
                         link_power=0.5)
    assert ds.train.count() == 180 and ds.test.count() == 60


def test_kmeans_does_not_depend_on_partitions(spark):
    X, _ = _clustered(240, 4)
    want = CL.kmeans_centers(rows_df(spark, X, parts=1), 4, 10, 42)
    for parts in (4, 7):
        got = CL.kmeans_centers(rows_df(spark, X, parts=parts), 4, 10, 42)
        assert np.allclose(got, want, atol=1e-12)
    with pytest.raises(ValueError):
        CL.kmeans_centers(rows_df(spark, X[:3]), 4)


def test_approximation_error_of_tiny_inputs(spark):
    X, _ = _clustered(60, 5)
    mk = MK.meka_features(rows_df(spark, X), n_clusters=2, target_rank=10, gamma=0.2, link_power=0.5)
    for n in (0, 1):
        r = MK.approximation_error(mk, rows_df(spark, X[:n]) if n else rows_df(spark, X).limit(0), 0.2, 3).first()
        assert r["n_pairs"] == 0 and r["mean_abs_error"] is None


def test_cluster_sizes_and_matrix_sum(spark):
    df = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "row_id bigint, cluster int")
    assert {r["cluster"]: r["n"] for r in A.cluster_sizes(df).collect()} == {0: 1, 1: 2}
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (1, 0, 5.0)], "i int, j int, value double")
    assert {(r["i"], r["j"]): r["value"] for r in A.matrix_sum(cells).collect()} == {(0, 0): 3.0, (1, 0): 5.0}

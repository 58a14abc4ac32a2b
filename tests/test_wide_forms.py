"""Tiles, Krylov spaces, matrix-free fits, oversampled starts, sort-free permutations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_df
from kernelspark.operators import cluster as CL
from kernelspark.operators import lanczos as LZ
from kernelspark.operators import linalg as L
from kernelspark.operators import sampling as S
from kernelspark.operators import svm as SVM
from kernelspark.operators import tiles as TL


def _matrix(tiles, d, tile):
    return L.cells_to_matrix(TL.cells(tiles, d, tile), d)


@pytest.mark.parametrize("d,tile", [(7, 3), (6, 2), (5, 8)])
def test_tiles_against_numpy(spark, d, tile):
    rng = np.random.default_rng(d)
    X, y = rng.normal(size=(90, d)), rng.normal(size=90)
    df = rows_df(spark, X, y, 4)
    g = TL.add_ridge(TL.tiled_gram(df, d, tile=tile), 0.5, d, tile)
    G = X.T @ X + 0.5 * np.eye(d)
    assert np.allclose(_matrix(g, d, tile), G)
    n = -(-d // tile)
    assert g.count() == n * (n + 1) // 2
    r = TL.tiled_cholesky(g, d, tile)
    R = np.triu(_matrix(r, d, tile))
    assert np.allclose(R, np.linalg.cholesky(G).T)
    z = TL.segment_values(TL.tiled_solve(r, TL.tiled_rmatvec(df, "label", d, tile=tile), d, tile), tile)
    assert np.allclose([x.value for x in z.orderBy("pos").collect()], np.linalg.solve(G, X.T @ y))


def test_tiles_of_wrong_inputs(spark):
    X = np.ones((20, 4))
    with pytest.raises(ValueError, match="positive definite"):
        TL.tiled_cholesky(TL.tiled_gram(rows_df(spark, X), 4, tile=2), 4, 2)
    with pytest.raises(Exception):
        TL.tiled_gram(rows_df(spark, X), 5, tile=2).count()
    assert TL.tiled_gram(rows_df(spark, X).limit(0), 4, tile=2).count() == 0


def test_sum_runs_adds_equal_keys(spark):
    rows = [(k % 3, bytes(np.array([1.0, k]))) for k in range(100)]
    got = {r.i: np.frombuffer(bytes(r.v)) for r in TL.sum_runs(spark.createDataFrame(rows, "i int, v binary").repartition(5), ["i"]).collect()}
    assert {i: v.tolist() for i, v in got.items()} == {i: [len(range(i, 100, 3)), float(sum(range(i, 100, 3)))] for i in range(3)}


@pytest.mark.parametrize("d,k,rank", [(30, 4, 30), (12, 12, 12), (20, 5, 3)])
def test_top_svd_against_numpy(spark, d, k, rank):
    rng = np.random.default_rng(d + k)
    X = rng.normal(size=(150, rank)) @ rng.normal(size=(rank, d))
    svd = LZ.top_svd(rows_df(spark, X, parts=5), k)
    s = np.linalg.svd(X, compute_uv=False)[:min(k, rank)]
    assert np.allclose(svd.s, s, rtol=1e-9)
    U = np.array([r["u"] for r in svd.U.orderBy("row_id").collect()])
    assert np.allclose(U.T @ U, np.eye(len(s)), atol=1e-8) and np.allclose(U * svd.s, X @ svd.V, atol=1e-8)
    assert np.all(svd.V[np.argmax(np.abs(svd.V), axis=0), range(len(s))] > 0)


def test_top_svd_wrong_inputs(spark):
    df = rows_df(spark, np.random.default_rng(0).normal(size=(40, 12)))
    for call in (lambda: LZ.top_svd(df, 13), lambda: LZ.top_svd(df.limit(0), 1), lambda: LZ.top_svd(df, 2, extra=0, max_steps=1)):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("d", [3, 20])
def test_newton_cg_finds_the_newton_optimum(spark, d):
    rng = np.random.default_rng(d)
    X = rng.normal(size=(300, d)) * np.logspace(0, 1.5, d)
    y = np.sign(X @ rng.normal(size=d) + rng.normal(size=300))
    df = rows_df(spark, X, y, 3)
    a = SVM.fit_svm(df, solver="newton", max_iter=50, tol=1e-9)
    b = SVM.fit_newton_cg(df, tol=1e-8)
    assert b.converged and np.allclose(a.weights, b.weights, atol=1e-4)
    gap = SVM.kkt_report(b.state, df, b.weights, 1.0).first()
    assert gap.max_alpha_gap < 1e-6
    with pytest.raises(ValueError, match="label"):
        SVM.fit_newton_cg(df.withColumn("label", F.lit(3.0)))


@pytest.mark.parametrize("parts", [1, 6])
def test_kmeans_parallel(spark, parts):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 3)) * 30
    X = np.vstack([c + rng.normal(size=(60, 3)) for c in centers])
    df = rows_df(spark, X, parts=parts)
    start = CL.kmeans_parallel(df, 6, seed=1)

    def cost(c):
        return ((X[:, None] - c[None]) ** 2).sum(2).min(1).sum()

    assert all((X == s).all(1).any() for s in start) and len({tuple(s) for s in start}) == 6
    assert np.array_equal(start, CL.kmeans_parallel(df.repartition(3), 6, seed=1))
    seeded = CL.kmeans_centers(df, 6, 10, 1)
    assert cost(CL.kmeans_centers(df, 6, 10, 1, start="parallel")) <= cost(seeded) + 1e-9
    assert cost(start) < 4 * cost(centers)


def test_kmeans_parallel_wrong_inputs(spark):
    same = rows_df(spark, np.ones((30, 2)))
    for call in (lambda: CL.kmeans_parallel(same, 2), lambda: CL.kmeans_parallel(same.limit(0), 1),
                 lambda: CL.kmeans_centers(same, 1, start="other")):
        with pytest.raises(ValueError):
            call()
    assert CL.kmeans_parallel(same, 1).tolist() == [[1.0, 1.0]]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12, 100, 101, 4097])
def test_feistel_is_a_bijection(spark, n):
    rows = S.feistel_permutation(spark.range(n).withColumnRenamed("id", "row_id"), n, 7).collect()
    assert sorted(r.perm_pos for r in rows) == list(range(n))
    if n > 1000:
        other = S.feistel_permutation(spark.range(n).withColumnRenamed("id", "row_id"), n, 8).collect()
        same = sum(a.perm_pos == b.perm_pos for a, b in zip(sorted(rows), sorted(other)))
        assert same < 20
        x = np.array([r.perm_pos for r in sorted(rows)])
        assert abs(np.corrcoef(x, np.arange(n))[0, 1]) < 0.06


def test_feistel_needs_no_exchange(spark):
    df = S.feistel_permutation(spark.range(1000).withColumnRenamed("id", "row_id"), 1000, 7)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    with pytest.raises(Exception):
        S.feistel_permutation(spark.range(5).withColumnRenamed("id", "row_id"), 3, 7).collect()
    big = spark.createDataFrame([((1 << 61) - 5,), (0,), (None,)], "row_id long")
    got = [r.perm_pos for r in S.feistel_permutation(big, 1 << 61, 7).collect()]
    assert got[2] is None and all(0 <= x < 1 << 61 for x in got[:2]) and got[0] != got[1]


def test_landmarks_without_a_broadcast(spark):
    """One cluster holds half of the rows, broadcasts are off: the rows of the broadcast form."""
    from kernelspark.operators import aggregates as A
    from kernelspark.operators import nystrom as NY
    rng = np.random.default_rng(6)
    X = rng.normal(size=(400, 3))
    cluster = [0 if i % 2 else 1 + i % 7 for i in range(400)]
    df = rows_df(spark, X, cluster, 5).select("row_id", "features", F.col("label").cast("int").alias("cluster"))
    ranks = A.rank_offsets(A.cluster_sizes(df).withColumn("rank", F.lit(3)), "cluster", "rank", "col_offset")
    want = {r.row_id: (r.cluster, list(r.u)) for r in NY.nystrom_features(df, ranks, 0.7, 5).collect()}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = NY.nystrom_features_joined(df, ranks, 0.7, 5)
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r.row_id: (r.cluster, list(r.u)) for r in out.collect()}
        with pytest.raises(Exception, match="no factor"):
            NY.nystrom_features_joined(df.withColumn("cluster", F.when(F.col("row_id") == 3, 99).otherwise(F.col("cluster"))),
                                       ranks, 0.7, 5).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and np.allclose(got[i][1], want[i][1], atol=1e-12) for i in want)


@pytest.mark.parametrize("pivots,block", [(1, 4096), (8, 10), (40, 1)])
def test_kernel_links_against_all_pairs(spark, pivots, block):
    """Repeated rows, a hot cell with a third of the rows, two sides of their own."""
    from kernelspark.operators import joins as J
    rng = np.random.default_rng(pivots)
    X = np.vstack([rng.normal(size=(120, 3)), np.zeros((60, 3)), rng.normal(size=(40, 3)) + 5])
    Y = np.vstack([X[::3] + 0.05, rng.normal(size=(50, 3))])
    df, other = rows_df(spark, X, parts=4), rows_df(spark, Y, parts=3)
    for right, Z, same in ((df, X, True), (other, Y, False)):
        value = np.exp(-0.8 * ((X[:, None] - Z[None]) ** 2).sum(2)) >= 0.7
        if same:
            np.fill_diagonal(value, False)
        out = J.kernel_links(df, right, "row_id", "row_id", 0.8, 0.7, pivots=pivots, block_rows=block, same_rows=same)
        assert "CartesianProduct" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
        got = {r.i: (r.n_links, r.first_link) for r in out.collect()}
        assert got == {i: (int(v.sum()), int(np.argmax(v)) if v.any() else None) for i, v in enumerate(value)}


def test_kernel_links_edges(spark):
    from kernelspark.operators import joins as J
    df = rows_df(spark, np.eye(3))
    assert J.kernel_links(df.limit(0), df, "row_id", "row_id", 1.0, 0.5).collect() == []
    assert [r.n_links for r in J.kernel_links(df, df.limit(0), "row_id", "row_id", 1.0, 0.5).collect()] == [0, 0, 0]
    assert [r.n_links for r in J.kernel_links(df, df, "row_id", "row_id", 1.0, 1.0).collect()] == [1, 1, 1]
    with pytest.raises(ValueError):
        J.kernel_links(df, df, "row_id", "row_id", 1.0, 0.0)
    with pytest.raises(Exception, match="null key"):
        J.kernel_links(df.withColumn("row_id", F.lit(None).cast("long")), df, "row_id", "row_id", 1.0, 0.5).collect()


def test_kernel_links_copies_are_few(spark):
    """Parts of few rows: the right rows are not copied to each of them."""
    from kernelspark.operators import joins as J
    rng = np.random.default_rng(5)
    X = rng.normal(size=(800, 64))
    X = (X / np.linalg.norm(X, axis=1)[:, None]).astype(np.float32).astype(float)
    df = rows_df(spark, X, parts=4)

    def written():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(k).length() for k in range(files.size()))

    before = written()
    got = {r.i: r.n_links for r in J.kernel_links(df, df, "row_id", "row_id", 1.0, 0.28, pivots=16, block_rows=1, same_rows=True).collect()}
    value = np.exp(-((X[:, None] - X[None]) ** 2).sum(2)) >= 0.28
    assert got == {i: int(v.sum()) - 1 for i, v in enumerate(value)}
    assert written() - before < 8 * X.nbytes        # the copies as 32-bit numbers: half of that


def test_link_parts():
    from kernelspark.operators import joins as J
    start, end, room, parts = J.link_parts([0, 3, 100_000, 5, 40], 20, 64)
    assert parts == J.LINK_COPIES and parts * room >= end[-1] == 100_048 and list(start) == [0, 0, 3, 100_003, 100_008]
    assert J.link_parts([10 ** 9], 20, 64)[3] == -(-10 ** 9 // (J.LINK_HELD_BYTES // 512))      # no more than a task can hold
    assert J.link_parts([4] * 10, 8, 2)[3] == 5

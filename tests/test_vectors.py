import numpy as np

from conftest import rows_df
from kernelspark.functions import vectors as V


def test_dot_sqdist_and_argmin_ties(spark):
    X = np.array([[1.0, 2.0, 3.0], [0.0, -1.0, 0.5]])
    df = rows_df(spark, X)
    w = [0.5, -1.0, 2.0]
    out = df.select("row_id", V.dot_const("features", w).alias("d"),
                    V.sqdist_const("features", [1.0, 1.0, 1.0]).alias("s"),
                    V.sqdist_const("features", [1.0, 1.0, 1.0], unroll=False).alias("s2"),
                    V.norm_l2("features").alias("n2"), V.norm_l1("features").alias("n1")
                    ).orderBy("row_id").collect()
    for r, x in zip(out, X):
        assert abs(r["d"] - x @ w) < 1e-12
        assert abs(r["s"] - np.sum((x - 1) ** 2)) < 1e-12
        assert abs(r["s2"] - r["s"]) < 1e-12
        assert abs(r["n2"] - np.linalg.norm(x)) < 1e-12
        assert abs(r["n1"] - np.abs(x).sum()) < 1e-12
    tie = spark.createDataFrame([([3.0, 1.0, 1.0, 2.0],)], "d array<double>")
    assert tie.select(V.argmin("d").alias("i")).first()["i"] == 1


def test_elementwise_ops(spark):
    df = spark.createDataFrame([([0.0, -2.0, 4.0, 0.00001],)], "x array<double>")
    r = df.select(V.elementwise_power("x", -0.5).alias("p"), V.clip_negative("x").alias("c"),
                  V.zero_small("x", 1e-4).alias("z"), V.elementwise_exp("x").alias("e"),
                  V.with_bias("x").alias("b"), V.slice0("x", 1, 3).alias("s")).first()
    assert r["p"][0] == 0.0 and abs(r["p"][2] - 0.5) < 1e-12 and np.isnan(r["p"][1])
    assert r["c"] == [0.0, 0.0, 4.0, 0.00001]
    assert r["z"] == [0.0, -2.0, 4.0, 0.0]
    assert abs(r["e"][2] - np.exp(4.0)) < 1e-9
    assert r["b"][-1] == 1.0 and len(r["b"]) == 5
    assert r["s"] == [-2.0, 4.0]


def test_wide_vectors_use_higher_order_functions(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(3, 200))
    w = rng.normal(size=200)
    df = rows_df(spark, X)
    out = df.select("row_id", V.dot_const("features", w).alias("d"),
                    V.sqdist_const("features", w).alias("s"),
                    V.dot("features", "features").alias("n")).orderBy("row_id").collect()
    for r, x in zip(out, X):
        assert abs(r["d"] - x @ w) < 1e-9
        assert abs(r["s"] - np.sum((x - w) ** 2)) < 1e-9
        assert abs(r["n"] - x @ x) < 1e-9

"""Gram and R per group from SQL."""

import numpy as np
import pytest

from kernelspark.functions import table_functions as TF


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g) if g else None, f"s{i % 3}", rng.normal(size=4).tolist()) for i, g in enumerate(rng.integers(0, 4, 300))]
    spark.createDataFrame(rows, "g int, s string, x array<double>").repartition(5).createOrReplaceTempView("ks_rows")
    return rows


def grouped(rows):
    out = {}
    for g, _, x in rows:
        out.setdefault(g, []).append(x)
    return {g: np.array(x) for g, x in out.items()}


def test_gram(spark, table):
    TF.register_gram(spark, "gram_a", "g int, s string")
    cells = spark.sql("SELECT g, i, j, sum(value) AS value, count(*) AS n FROM gram_a(TABLE(SELECT g, s, x FROM ks_rows) PARTITION BY (g, s)) GROUP BY g, i, j").collect()
    want = {g: x.T @ x for g, x in grouped(table).items()}
    assert len(cells) == 10 * len(want) and all(r.n == 3 and abs(r.value - want[r.g][r.i, r.j]) < 1e-9 for r in cells)


def test_r_of_r_factors(spark, table):
    TF.register_r(spark, "r_a", "g int, s string")
    TF.register_r(spark, "r_b", "g int")
    rows = spark.sql("SELECT * FROM r_b(TABLE(SELECT g, row FROM r_a(TABLE(SELECT g, s, x FROM ks_rows) PARTITION BY (g, s))) PARTITION BY g)").collect()
    for g, x in grouped(table).items():
        R = np.array([r.row for r in sorted((r for r in rows if r.g == g), key=lambda r: r.i)])
        assert np.allclose(R.T @ R, x.T @ x) and np.all(np.diag(R) >= 0) and np.allclose(R, np.triu(R))


def test_few_rows_no_keys_and_wrong_vectors(spark):
    TF.register_r(spark, "r_c")
    TF.register_gram(spark, "gram_c")
    got = spark.sql("SELECT * FROM r_c(TABLE(SELECT array(3D, 4D, 1D) AS x))").collect()
    assert [(r.i, list(r.row)) for r in got] == [(0, [3.0, 4.0, 1.0])]
    assert spark.sql("SELECT * FROM gram_c(TABLE(SELECT array(1D) AS x WHERE false))").count() == 0
    for bad in ("SELECT array(1D, 2D) AS x UNION ALL SELECT array(1D)", "SELECT array(1D) AS x UNION ALL SELECT CAST(NULL AS array<double>)"):
        with pytest.raises(Exception):
            spark.sql(f"SELECT * FROM gram_c(TABLE({bad}) WITH SINGLE PARTITION)").collect()

"""Clusters of dense rows (H1-H4).

K centers are small (K x d on the driver); rows never leave Spark. Every
per-cluster table (sizes, ranks, offsets) has K rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package
from . import aggregates as A
from . import joins as J
from . import linalg as L
from . import sampling as S


def kmeans_centers(df: DataFrame, k: int, max_iter: int = 10, seed: int = 42,
                   features: str = "features", id_cols: Sequence[str] = ("row_id",), start: str = "rows") -> np.ndarray:
    """H1: k-means -> K x d centers. Lloyd iterations from the first k rows of
    the seeded md5 order (``start="rows"``) or from ``kmeans_parallel``
    (``start="parallel"``); neither depends on the partitioning."""
    if start == "parallel":
        return lloyd(df, kmeans_parallel(df, k, seed, features=features, id_cols=id_cols), max_iter, features)
    if start != "rows":
        raise ValueError(f"unknown start {start!r}")
    key = S.perm_key(seed, id_cols)
    first = df.select(key.alias("_ks_key"), *id_cols, features).orderBy("_ks_key", *id_cols).limit(k).collect()
    if len(first) < k:
        raise ValueError(f"{len(first)} rows for {k} clusters")
    return lloyd(df, [list(r[features]) for r in first], max_iter, features)


def kmeans_parallel(df: DataFrame, k: int, seed: int = 42, oversample: float | None = None, rounds: int = 5,
                    features: str = "features", id_cols: Sequence[str] = ("row_id",)) -> np.ndarray:
    """Starting centers by oversampling (k-means||), K x d.

    From the first row of the seeded order, each round draws every row with
    probability oversample * d^2 / (sum of all d^2), d^2 being its distance to
    the nearest candidate so far; ``oversample`` is 2 k by default. Draws are
    md5 hashes of seed, round and id, so they do not depend on the
    partitioning. The candidates, weighted by the rows nearest to them, are
    reduced to k: the heaviest first, then always the one with the greatest
    weight times distance to the chosen (ties: the earlier candidate, by round
    and id). About 1 + rounds * oversample candidates reach the driver; their
    bytes are checked. Repeated rows are drawn each on its own; fewer
    distinct rows than k raise, as does an empty table."""
    draws = 2.0 * k if oversample is None else oversample
    first = df.select(S.perm_key(seed, id_cols).alias("_ks_key"), *id_cols, features).orderBy("_ks_key", *id_cols).first()
    if first is None:
        raise ValueError("empty input")
    found = [list(first[features])]
    for r in range(1, rounds + 1):
        near = assign_clusters(df.select(*id_cols, features), J.check_centers(found), features)
        cost = near.agg(F.sum("sq_dist")).first()[0]
        if not cost > 0:
            break
        u = F.conv(F.substring(S.perm_key(f"{seed}:{r}", id_cols), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
        picked = near.where(u < F.lit(draws) * F.col("sq_dist") / F.lit(float(cost))).select(*id_cols, features).orderBy(*id_cols)
        found += [list(x[features]) for x in picked.toLocalIterator()]
    points = J.check_centers(found)
    weight = lloyd_sums(df, points, features)[0].astype(float)
    chosen: list[int] = []
    gain = weight.copy()
    nearest = np.full(len(points), np.inf)
    while len(chosen) < k:
        best = int(np.argmax(gain))
        if not gain[best] > 0:
            raise ValueError(f"{len(chosen)} distinct candidates for {k} clusters: more rounds or oversampling are needed")
        chosen.append(best)
        nearest = np.minimum(nearest, J.block_distances(points, points[best:best + 1])[:, 0])
        gain = weight * nearest
    return points[chosen]


def assign_clusters(df: DataFrame, centers, features: str = "features",
                    out: str = "cluster") -> DataFrame:
    """H2 = C2 + E5: nearest center (ties to the lower index) and its
    squared distance; a narrow map that reads only the vectors."""
    c = J.check_centers(centers)
    ship_package(df.sparkSession)

    @F.arrow_udf("struct<c: int, d: double>")
    def nearest(x: pa.Array) -> pa.Array:
        dist = J.block_distances(L.list_matrix(x, c.shape[1]), c)
        at = dist.argmin(axis=1)
        return pa.StructArray.from_arrays(
            [pa.array(at, pa.int32()), pa.array(dist[np.arange(len(at)), at], pa.float64())], ["c", "d"])

    return (df.withColumn("_ks_b", nearest(F.col(features)))
              .withColumn(out, F.col("_ks_b.c")).withColumn("sq_dist", F.col("_ks_b.d")).drop("_ks_b"))


def lloyd_sums(df: DataFrame, centers, features: str = "features") -> tuple[np.ndarray, np.ndarray]:
    """Rows and vector sums of the nearest-center clusters: one K x (d + 1)
    block per task, merged as blocks (a hot cluster is one line of each)."""
    c = J.check_centers(centers)
    k, d = c.shape

    def add(block, b):
        X = L.batch_matrix(b, features, d)
        at = J.block_distances(X, c).argmin(axis=1)
        cells = block.reshape(k, d + 1)
        for i in np.unique(at):
            rows = X[at == i]
            cells[i, 0] += len(rows)
            cells[i, 1:] += rows.sum(axis=0)

    total = A.collect_block_sum(A.block_partials(df.select(features), k * (d + 1), add), k * (d + 1)).reshape(k, d + 1)
    return total[:, 0].astype(np.int64), total[:, 1:]


def lloyd_step(df: DataFrame, centers, features: str = "features") -> DataFrame:
    """One Lloyd step from given centers: assign, then the mean of each
    cluster. ``(cluster int, n bigint, center array<double>)``, K rows at
    most; a cluster without rows is absent."""
    n, sums = lloyd_sums(df, centers, features)
    rows = [(i, int(n[i]), (sums[i] / n[i]).tolist()) for i in range(len(n)) if n[i]]
    return df.sparkSession.createDataFrame(rows, "cluster int, n bigint, center array<double>")


def lloyd(df: DataFrame, centers, iterations: int, features: str = "features") -> np.ndarray:
    """Lloyd steps from given centers (K x d on the driver per step); a
    center without rows stays where it is."""
    cen = np.array(centers, dtype=float)
    for _ in range(iterations):
        n, sums = lloyd_sums(df, cen, features)
        cen[n > 0] = sums[n > 0] / n[n > 0, None]
    return cen


def rbf_matrix(X: np.ndarray, Y: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma ||x - y||^2) for small local blocks."""
    sq = (np.sum(X * X, 1)[:, None] + np.sum(Y * Y, 1)[None, :] - 2.0 * X @ Y.T)
    return np.exp(-gamma * np.maximum(sq, 0.0))


def rbf_matrix_exact(X: np.ndarray, Y: np.ndarray, gamma: float) -> np.ndarray:
    """Same, by explicit differences (bit-for-bit like the SQL twin)."""
    diff = X[:, None, :] - Y[None, :, :]
    return np.exp(-gamma * np.sum(diff * diff, axis=2))


def center_kernel(spark: SparkSession, centers, gamma: float) -> DataFrame:
    """K x K kernel of the centers as ``(i int, j int, value double)``."""
    c = np.asarray(centers, dtype=float)
    K = rbf_matrix_exact(c, c, gamma)
    return spark.createDataFrame(
        [(i, j, float(K[i, j])) for i in range(len(c)) for j in range(len(c))],
        "i int, j int, value double")


def link_threshold(centers, gamma: float, eta: float, spark=None) -> tuple[float, int]:
    """H3: all K^2 center-kernel entries sorted ascending; the entry at
    position mm = ceil((K^2 - K) * eta) (1-based), 0.0 when mm = 0."""
    c = np.asarray(centers, dtype=float)
    k = len(c)
    mm = int(math.ceil((k * k - k) * eta))
    if mm <= 0:
        return 0.0, 0
    flat = np.sort(rbf_matrix_exact(c, c, gamma).ravel())
    return float(flat[mm - 1]), mm


def linked_pairs(centers, gamma: float, eta: float) -> list[tuple[int, int]]:
    """C5 on the driver: pairs i < j with kernel >= threshold."""
    c = np.asarray(centers, dtype=float)
    thr, _ = link_threshold(c, gamma, eta)
    K = rbf_matrix_exact(c, c, gamma)
    return [(i, j) for i in range(len(c)) for j in range(i + 1, len(c)) if K[i, j] >= thr]


def rank_allocation(sizes: DataFrame, target_rank: int, cluster: str = "cluster",
                    n: str = "n") -> DataFrame:
    """H4 + F1: rank_c = ceil(target * n_c / N); the surplus over the target
    is taken from the last cluster; then min(rank_c, n_c); a rank below 1
    raises. Column offsets are the running sum of the final ranks.
    ``sizes`` has one row per cluster (K rows), so the windows are small.
    """
    whole = Window.partitionBy(F.lit(1))
    r0 = sizes.select(
        F.col(cluster).cast("int").alias("cluster"), F.col(n).alias("n"),
        F.ceil(F.lit(target_rank) * F.col(n) / F.sum(n).over(whole)).cast("int").alias("r"),
        F.max(cluster).over(whole).alias("_last"))
    r1 = r0.withColumn("r", F.when(F.col("cluster") == F.col("_last"),
                                   F.col("r") - (F.sum("r").over(whole) - F.lit(target_rank)))
                       .otherwise(F.col("r")))
    r2 = r1.select("cluster", "n", F.least(F.col("r"), F.col("n")).cast("int").alias("rank"))
    r2 = r2.withColumn("rank", F.when(F.col("rank") < 1, F.raise_error(
        F.lit("rank allocation left a cluster with rank < 1"))).otherwise(F.col("rank")))
    return A.rank_offsets(r2, "cluster", "rank", "col_offset")

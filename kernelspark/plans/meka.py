"""MEKA: memory-efficient kernel approximation as Spark jobs.

k-means (Lloyd) -> nearest center per row (narrow) -> cluster sizes and
ranks (K-row tables) -> per-cluster Nystrom factors from sampled landmarks
-> link matrix S between linked clusters -> one narrow ``mapInArrow`` pass
giving every row its target_rank features -> exact seeded split.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import cluster as CL
from ..operators import nystrom as NY
from ..operators import sampling as S


class MekaFeatures(NamedTuple):
    features: DataFrame     # row_id, cluster, features array<double> (target_rank)
    centers: np.ndarray
    ranks: DataFrame        # cluster, n, rank, col_offset
    link: np.ndarray
    apply: Callable[..., DataFrame]     # the map on other rows: (rows, keep) -> as ``features``


class MekaDataset(NamedTuple):
    train: DataFrame        # row_id, features, label
    test: DataFrame
    meka: MekaFeatures


def meka_features(rows: DataFrame, n_clusters: int = 4, target_rank: int = 40,
                  gamma: float = 0.1, eta: float = 0.1, seed: int = 42,
                  link_power: float = -0.5, kmeans_iter: int = 10,
                  features: str = "features", keep: tuple[str, ...] = ()) -> MekaFeatures:
    """Rows ``(row_id, features, ...)`` -> MEKA features of target_rank."""
    base = rows.select("row_id", features)
    centers = CL.kmeans_centers(base, n_clusters, kmeans_iter, seed, features)
    centers, sizes = _number_by_size(base, centers, features)
    spark = rows.sparkSession
    ranks = CL.rank_allocation(spark.createDataFrame(sizes, "cluster int, n bigint"), target_rank)
    ranks = spark.createDataFrame([tuple(r) for r in ranks.collect()], ranks.schema)      # K rows
    assigned = CL.assign_clusters(base, centers, features).drop("sq_dist")
    maps = NY.nystrom_maps(assigned, ranks, gamma, seed, features=features)
    pairs = CL.linked_pairs(centers, gamma, eta)
    Smat = NY.link_matrix(assigned, ranks, maps, pairs, gamma, seed, features)
    proj = NY.link_projection(Smat, maps, link_power)

    def apply(some: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        placed = CL.assign_clusters(some.select("row_id", features, *keep), centers, features)
        return NY.map_rows(placed, maps, gamma, proj, out="features",
                           keep=("row_id", "cluster", *keep), features=features)

    return MekaFeatures(apply(rows, keep), centers, ranks, Smat, apply)


def _number_by_size(rows: DataFrame, centers: np.ndarray, features: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Renumber the k-means clusters by ascending size (K-row count table);
    returns the centers and (number, size).

    Cluster numbers are arbitrary; with the largest cluster last, the rank
    rule of H4 (surplus over the target taken from the last cluster) takes
    it from the cluster that can best afford it."""
    n, _ = CL.lloyd_sums(rows, centers, features)
    order = sorted(range(len(centers)), key=lambda c: (n[c], c))
    return np.asarray(centers)[order], [(i, int(n[c])) for i, c in enumerate(order) if n[c]]


def meka_dataset(rows: DataFrame, n_clusters: int = 4, target_rank: int = 40,
                 gamma: float = 0.1, eta: float = 0.1, split: float = 0.8, seed: int = 42,
                 link_power: float = -0.5, kmeans_iter: int = 10) -> MekaDataset:
    """H9: MEKA features of labelled rows, split exactly by the seeded
    permutation. Train rows stay unsigned; the SVM signs them once."""
    mk = meka_features(rows, n_clusters, target_rank, gamma, eta, seed, link_power, kmeans_iter)
    # split the input by id first: each row is mapped once, by the side that uses it
    train, test = (mk.apply(part, ("label",)).select("row_id", "features", "label")
                   for part in S.train_test_split(rows, split, seed, ["row_id"]))
    return MekaDataset(train, test, mk)


def approximation_error(meka: MekaFeatures, rows: DataFrame, gamma: float, seed: int,
                        n_pairs: int = 2000) -> DataFrame:
    """Mean |k(x_a, x_b) - phi_a . phi_b| over a seeded sample of
    row pairs: the first 2 m rows of the md5 order (m = n_pairs, or fewer on
    small inputs), row p paired with row p + m. A sampling operator: the
    sample size is the feature. The sample is chosen by id and only its rows
    are mapped. Fewer than two rows: no pairs, error null."""
    n = rows.count()
    m = min(n_pairs, n // 2)
    key = S.perm_key(seed, ["row_id"])
    sample = rows.select("row_id", "features").filter(S.in_first(rows, seed, ["row_id"], k=2 * m))
    ranked = S.uniform_rank(sample.withColumn("_k", key), "_k", ["row_id"], out="pos").select("row_id", "pos", F.col("features").alias("x"))
    phi = meka.apply(sample).select("row_id", F.col("features").alias("phi"))
    both = ranked.join(phi, "row_id")
    left = both.filter(F.col("pos") < F.lit(m)).select(
        F.col("pos").alias("pair"), F.col("phi").alias("pa"), F.col("x").alias("xa"))
    right = both.filter(F.col("pos") >= F.lit(m)).select(
        (F.col("pos") - F.lit(m)).alias("pair"), F.col("phi").alias("pb"), F.col("x").alias("xb"))
    pairs = left.join(right, "pair")
    diff = F.abs(F.exp(V.sqdist("xa", "xb") * F.lit(-gamma)) - V.dot("pa", "pb"))
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"),
                     F.round(F.avg(diff), 4).alias("mean_abs_error"))

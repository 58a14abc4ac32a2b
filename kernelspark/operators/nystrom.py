"""Clustered Nystrom features and the MEKA link matrix.

Only landmark-sized objects leave Spark: per cluster at most 2 * rank
landmarks (H5) and 4 * rank link samples (H6), all chosen by the seeded md5
order with a partial top-m per map task. Each cluster's small SVD and each
linked pair's solve is a task of its own; the per-row map K(x, L_c) T_c P_c is one ``mapInArrow`` pass
over all rows with the (landmark-sized) factors broadcast.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package, stored
from . import linalg as L
from . import sampling as S
from .cluster import rbf_matrix


class ClusterMap(NamedTuple):
    cluster: int
    landmarks: np.ndarray    # m x d
    T: np.ndarray            # m x k  (U_k S_k^-1/2)
    rank: int
    offset: int


def inv_sqrt_values(s: np.ndarray, rcond: float) -> np.ndarray:
    """s^-1/2 on values above rcond * max(s); the rest (and exact zeros) 0."""
    out = np.zeros_like(s)
    if len(s) == 0:
        return out
    keep = s > rcond * s.max()
    out[keep] = s[keep] ** -0.5
    return out


def sample_per_cluster(assigned: DataFrame, ranks: DataFrame, factor: int, seed: int,
                       max_rank: int, features: str = "features", hint: bool = True) -> DataFrame:
    """min(factor * rank_c, n_c) rows of each cluster, first of the seeded
    permutation (F4). ``ranks`` has K rows and is broadcast (``hint``)."""
    sizes = ranks.select("cluster", "n", "rank")
    withm = assigned.join(F.broadcast(sizes) if hint else sizes, "cluster").withColumn(
        "_ks_m", F.least(F.lit(factor) * F.col("rank"), F.col("n")))
    return S.sample_n(withm, seed, ["row_id"], "cluster", F.col("_ks_m"), factor * max_rank) \
        .select("cluster", "row_id", "sample_pos", features)


def _check_sample(ranks: dict[int, tuple[int, int]], factor: int, d: int) -> None:
    """The samples of all clusters are sum(factor * rank) rows; refuse more
    than ``MAX_BLOCK_BYTES`` of them before anything is collected."""
    size = sum(factor * r for r, _ in ranks.values()) * d * 8
    if size > L.MAX_BLOCK_BYTES:
        raise ValueError(f"{size} bytes of sampled rows exceed {L.MAX_BLOCK_BYTES}")


def _rank_table(ranks: DataFrame, limit: int = 4096) -> dict[int, tuple[int, int]]:
    rows = ranks.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} clusters")
    return {int(r["cluster"]): (int(r["rank"]), int(r["col_offset"])) for r in rows}


def nystrom_maps(assigned: DataFrame, ranks: DataFrame, gamma: float, seed: int,
                 rcond: float = 1e-10, features: str = "features", factor: int = 2) -> dict[int, ClusterMap]:
    """H5 factors: per cluster m = min(factor * rank, n) landmarks, W = K(L, L),
    W = U S U^T, T = U_k S_k^-1/2 (k = rank); one task per cluster."""
    rk = _rank_table(ranks)
    _check_sample(rk, factor, L.width(assigned, features))
    ship_package(assigned.sparkSession)

    def factors(key, pdf):
        import pandas as pd
        Lc = np.stack(pdf.sort_values("sample_pos")[features].to_numpy())
        U, s, _ = np.linalg.svd(rbf_matrix(Lc, Lc, gamma))
        rank = rk[int(key[0])][0]
        Tc = U[:, :rank] * inv_sqrt_values(s, rcond)[:rank]
        return pd.DataFrame({"cluster": [int(key[0])], "m": [len(Lc)], "l": [Lc.ravel()], "t": [Tc.ravel()]})

    samples = sample_per_cluster(assigned, ranks, factor, seed, max(r for r, _ in rk.values()), features)
    rows = samples.groupBy("cluster").applyInPandas(
        factors, "cluster int, m int, l array<double>, t array<double>").collect()
    return {r["cluster"]: ClusterMap(r["cluster"], np.array(r["l"]).reshape(r["m"], -1), np.array(r["t"]).reshape(r["m"], -1),
                                     *rk[r["cluster"]]) for r in rows}


def map_rows(assigned: DataFrame, maps: dict[int, ClusterMap], gamma: float,
             proj: dict[int, np.ndarray] | None = None, out: str = "u",
             keep: tuple[str, ...] = ("row_id", "cluster"),
             features: str = "features") -> DataFrame:
    """Per row of cluster c: K(x, L_c) T_c (H5), times P_c when ``proj``
    is given (H8). One narrow ``mapInArrow`` pass; factors broadcast."""
    spark = assigned.sparkSession
    ship_package(spark)
    factors = {c: (m.landmarks, m.T if proj is None else m.T @ proj[c]) for c, m in maps.items()}
    bc = spark.sparkContext.broadcast(factors)
    d = next(iter(maps.values())).landmarks.shape[1]
    fields = [assigned.schema[k] for k in keep]
    schema = T.StructType(fields + [T.StructField(out, T.ArrayType(T.DoubleType()))])
    arrow_fields = [pa.field(f.name, L._arrow_type(f.dataType)) for f in fields]
    arrow_schema = pa.schema(arrow_fields + [pa.field(out, pa.list_(pa.float64()))])

    def fn(batches):
        fac = bc.value
        for b in batches:
            X = L.batch_matrix(b, features, d)
            cl = b.column(b.schema.get_field_index("cluster")).to_numpy(zero_copy_only=False)
            # one block per cluster, the rows in cluster order, then put back by one take
            order = np.argsort(cl, kind="stable")
            present, start = np.unique(cl[order], return_index=True)
            values, widths = [np.zeros(0)], []
            for c, lo, hi in zip(present, start, np.append(start[1:], len(cl))):
                Lc, Mc = fac[int(c)]
                Y = rbf_matrix(X[order[lo:hi]], Lc, gamma) @ Mc
                values.append(Y.ravel())
                widths.append(np.full(hi - lo, Y.shape[1]))
            offsets = np.concatenate([[0], *widths]).cumsum().astype(np.int32)
            sorted_rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))
            back = np.empty(len(cl), np.int64)
            back[order] = np.arange(len(cl))
            cols = [b.column(b.schema.get_field_index(k)).cast(arrow_schema.field(i).type)
                    for i, k in enumerate(keep)]
            yield pa.RecordBatch.from_arrays(cols + [sorted_rows.take(pa.array(back))], schema=arrow_schema)

    return assigned.select(*dict.fromkeys(list(keep) + [features, "cluster"])).mapInArrow(fn, schema)


def nystrom_features(assigned: DataFrame, ranks: DataFrame, gamma: float, seed: int,
                     rcond: float = 1e-10, features: str = "features", factor: int = 2) -> DataFrame:
    """H5 over all rows: ``(row_id, cluster, u array<double>)``, rank_c values."""
    maps = nystrom_maps(assigned, ranks, gamma, seed, rcond, features, factor)
    return map_rows(assigned, maps, gamma, features=features)


#: Parts in which a cluster's rows meet its factor (``nystrom_features_joined``).
SALTS = 16


def nystrom_factors(assigned: DataFrame, ranks: DataFrame, gamma: float, seed: int, rcond: float = 1e-10,
                    features: str = "features", factor: int = 2) -> DataFrame:
    """The factors of ``nystrom_maps`` as a table that stays in Spark: cluster,
    m, l (landmarks) and t (m x rank), binary doubles. Any number of clusters;
    a task holds one cluster's landmarks."""
    ship_package(assigned.sparkSession)
    most = ranks.agg(F.max("rank")).first()[0]
    picked = sample_per_cluster(assigned, ranks, factor, seed, most, features, hint=False)
    withrank = picked.join(ranks.select("cluster", "rank"), "cluster")

    def factors(key, pdf):
        import pandas as pd
        Lc = np.stack(pdf.sort_values("sample_pos")[features].to_numpy())
        U, s, _ = np.linalg.svd(rbf_matrix(Lc, Lc, gamma))
        rank = int(pdf["rank"].iloc[0])
        Tc = U[:, :rank] * inv_sqrt_values(s, rcond)[:rank]
        return pd.DataFrame({"cluster": [int(key[0])], "m": [len(Lc)], "l": [Lc.tobytes()], "t": [np.ascontiguousarray(Tc).tobytes()]})

    return withrank.groupBy("cluster").applyInPandas(factors, "cluster int, m int, l binary, t binary")


def nystrom_features_joined(assigned: DataFrame, ranks: DataFrame, gamma: float, seed: int, rcond: float = 1e-10,
                            features: str = "features", factor: int = 2, salts: int = SALTS) -> DataFrame:
    """``nystrom_features`` without a broadcast and without a collected
    factor: rows and factors meet by (cluster, salt). A cluster's rows are
    dealt over ``salts`` parts by a hash of their id, its factor is copied to
    each, and every part streams through a task behind its factor, so a
    cluster of any size is held a batch at a time. A row whose cluster has
    no rank raises."""
    factors = stored(nystrom_factors(assigned, ranks, gamma, seed, rcond, features, factor), "factors")
    salt = F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int").alias("salt")
    rows = assigned.select(F.col("cluster").cast("int").alias("cluster"), salt, F.lit(1).alias("kind"), "row_id", features)
    heads = factors.select("cluster", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "m", "l", "t")
    both = heads.unionByName(rows, allowMissingColumns=True).select("cluster", "salt", "kind", "m", "l", "t", "row_id", features)
    schema = T.StructType([assigned.schema["row_id"], T.StructField("cluster", T.IntegerType()), T.StructField("u", T.ArrayType(T.DoubleType()))])

    def fn(batches):
        here, Lc, Tc = None, None, None
        for b in batches:
            part = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            turn = np.any([p[1:] != p[:-1] for p in part], axis=0) if b.num_rows else np.zeros(0, bool)
            cuts = [0, *(np.flatnonzero(turn) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                key = int(part[0][lo]), int(part[1][lo])
                if not part[2][lo]:
                    m = b.column(3)[lo].as_py()
                    here, Lc, Tc = key, *(np.frombuffer(b.column(i)[lo].as_py()).reshape(m, -1) for i in (4, 5))
                    continue
                if key != here:
                    raise ValueError(f"cluster {key[0]} has rows but no factor")
                X = L.list_matrix(b.column(7).slice(lo, hi - lo), Lc.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [b.column(6).slice(lo, hi - lo), pa.array(np.full(hi - lo, key[0], np.int32)), L.matrix_to_list_array(rbf_matrix(X, Lc, gamma) @ Tc)],
                    names=["row_id", "cluster", "u"])

    return both.repartition("cluster", "salt").sortWithinPartitions("cluster", "salt", "kind").mapInArrow(fn, schema)


def link_matrix(assigned: DataFrame, ranks: DataFrame, maps: dict[int, ClusterMap],
                pairs: list[tuple[int, int]], gamma: float, seed: int,
                features: str = "features") -> np.ndarray:
    """H6: the target_rank x target_rank link matrix S. Identity blocks on
    the diagonal; for each linked pair (i, j), with min(4 rank, n) sampled
    rows per side, Z = pinv(U_i) K(A_i, A_j) pinv(U_j)^T at the rank
    offsets, and Z^T mirrored (pinv instead of the reference's inverse of
    the normal equations, which fails when they are singular)."""
    rk = {c: (m.rank, m.offset) for c, m in maps.items()}
    Smat = np.eye(sum(r for r, _ in rk.values()))
    if not pairs:
        return Smat
    _check_sample(rk, 4, next(iter(maps.values())).landmarks.shape[1])
    spark = assigned.sparkSession

    def side(key, pdf):
        import pandas as pd
        c = int(key[0])
        rows = np.stack(pdf.sort_values("sample_pos")[features].to_numpy())
        inverse = np.linalg.pinv(rbf_matrix(rows, maps[c].landmarks, gamma) @ maps[c].T)
        return pd.DataFrame({"c": [c], "m": [len(rows)], "a": [rows.ravel()], "p": [inverse.ravel()]})

    def blocks(frames):
        import pandas as pd
        for f in frames:
            z = [np.asarray(r.pi).reshape(-1, r.mi) @ rbf_matrix(np.asarray(r.ai).reshape(r.mi, -1), np.asarray(r.aj).reshape(r.mj, -1), gamma)
                 @ np.asarray(r.pj).reshape(-1, r.mj).T for r in f.itertuples()]
            yield pd.DataFrame({"i": f["i"], "j": f["j"], "z": [x.ravel() for x in z]})

    samples = sample_per_cluster(assigned, ranks, 4, seed + 1, max(r for r, _ in rk.values()), features)
    sides = samples.groupBy("cluster").applyInPandas(side, "c int, m int, a array<double>, p array<double>")

    def named(x):
        return sides.select(F.col("c").alias(x), *[F.col(k).alias(k + x) for k in "map"])
    links = spark.createDataFrame(pairs, "i int, j int")
    for r in links.join(named("i"), "i").join(named("j"), "j").mapInPandas(blocks, "i int, j int, z array<double>").collect():
        Z = np.array(r["z"]).reshape(maps[r["i"]].rank, -1)
        oi, oj = maps[r["i"]].offset, maps[r["j"]].offset
        Smat[oi:oi + Z.shape[0], oj:oj + Z.shape[1]] = Z
        Smat[oj:oj + Z.shape[1], oi:oi + Z.shape[0]] = Z.T
    return Smat


def link_projection(Smat: np.ndarray, maps: dict[int, ClusterMap], power: float = -0.5,
                    rcond: float = 1e-10) -> dict[int, np.ndarray]:
    """H8: P = SU * SS^p (SVD of S), cut into the row blocks of each
    cluster's offset. p = -0.5 is the reference's choice; only p = +0.5
    makes phi phi^T approximate the kernel."""
    SU, ss, _ = np.linalg.svd(Smat)
    scale = np.zeros_like(ss)
    keep = ss > rcond * (ss.max() if len(ss) else 0.0)
    scale[keep] = ss[keep] ** power
    P = SU * scale
    return {c: P[m.offset:m.offset + m.rank, :] for c, m in maps.items()}


def block_features(df: DataFrame, u: str, offset: str, total: int, out: str = "features") -> DataFrame:
    """H7: the cluster's features at its column offset, zeros elsewhere."""
    pad_l = F.array_repeat(F.lit(0.0), F.col(offset).cast("int"))
    pad_r = F.array_repeat(F.lit(0.0), (F.lit(total) - F.col(offset) - F.size(u)).cast("int"))
    return df.withColumn(out, F.concat(pad_l, F.col(u), pad_r))

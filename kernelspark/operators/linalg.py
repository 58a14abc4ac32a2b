"""Tall-skinny linear algebra on DataFrames of dense rows.

Rows live in Spark; only d x d (or smaller) matrices reach the driver, and
only those are broadcast. Heavy per-row work is either a plain column
expression (small d, unrolled, whole-stage codegen) or numpy on Arrow
batches inside ``mapInArrow`` (per-partition partials, never a whole
partition in memory). Results do not depend on the partitioning.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..session import forget, ship_package
from . import aggregates as A

# Most bytes that one merge of d x d blocks may hold (a group of ``TSQR_FAN``
# blocks, in a task or on the driver); wider inputs are refused.
MAX_BLOCK_BYTES = 1 << 30
# Widths up to this use the SQL form of the Gram aggregate (d(d+1)/2 sums).
GRAM_SQL_MAX = 16
# Fan-in of one level of the TSQR reduction tree.
TSQR_FAN = 32


def _spark(df: DataFrame) -> SparkSession:
    return df.sparkSession


def width(df: DataFrame, col: str = "features") -> int:
    """d from the first row (verified on all rows where it matters)."""
    row = df.select(F.size(col).alias("d")).first()
    if row is None:
        raise ValueError("empty input")
    d = int(row["d"])
    if TSQR_FAN * d * d * 8 > MAX_BLOCK_BYTES:
        raise ValueError(f"width {d}: {TSQR_FAN} blocks of d x d doubles exceed {MAX_BLOCK_BYTES} bytes")
    return d


# ---------------------------------------------------------------- Arrow helpers

def batch_matrix(batch: pa.RecordBatch, col: str, d: int) -> np.ndarray:
    """An Arrow list<double> column as an (n, d) float64 array."""
    return list_matrix(batch.column(batch.schema.get_field_index(col)), d, repr(col))


def list_matrix(arr: pa.Array, d: int, what: str = "the vectors") -> np.ndarray:
    """An Arrow list<double> array as an (n, d) float64 array."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return np.zeros((0, d))
    if arr.null_count:
        raise ValueError(f"null vectors in {what}")
    offsets = np.asarray(arr.offsets)
    if not np.all(np.diff(offsets) == d):
        raise ValueError(f"rows of {what} are not all of width {d}")
    values = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(n, d)


def matrix_to_list_array(m: np.ndarray) -> pa.Array:
    n, d = m.shape
    offsets = pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32) if n else np.zeros(1, np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(m).ravel(),
                                                      type=pa.float64()))


def _arrow_type(dt: T.DataType) -> pa.DataType:
    if isinstance(dt, T.LongType):
        return pa.int64()
    if isinstance(dt, T.IntegerType):
        return pa.int32()
    if isinstance(dt, T.DoubleType):
        return pa.float64()
    if isinstance(dt, T.StringType):
        return pa.string()
    if isinstance(dt, T.ArrayType):
        return pa.list_(_arrow_type(dt.elementType))
    if isinstance(dt, T.FloatType):
        return pa.float32()
    raise TypeError(f"unsupported type {dt}")


def project_rows(df: DataFrame, col: str, matrix: np.ndarray, out: str = "projected",
                 keep: tuple[str, ...] = ("row_id",), post=None) -> DataFrame:
    """Row-wise linear map y = x M (M is d_in x d_out, broadcast).

    ``post`` optionally maps the (n, d_out) block further (e.g. a kernel).
    Output: ``keep`` columns + ``out array<double>``.
    """
    M = np.asarray(matrix, dtype=np.float64)
    d_in = M.shape[0]
    spark = _spark(df)
    ship_package(spark)
    bc = spark.sparkContext.broadcast(M)
    fields = [df.schema[k] for k in keep]
    schema = T.StructType(fields + [T.StructField(out, T.ArrayType(T.DoubleType()))])
    arrow_schema = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in fields]
                             + [pa.field(out, pa.list_(pa.float64()))])

    def fn(batches):
        Mv = bc.value
        for b in batches:
            X = batch_matrix(b, col, d_in)
            Y = X @ Mv
            if post is not None:
                Y = post(X, Y)
            cols = [b.column(b.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays(
                [c.cast(arrow_schema.field(i).type) for i, c in enumerate(cols)]
                + [matrix_to_list_array(Y)], schema=arrow_schema)

    return df.select(*keep, col).mapInArrow(fn, schema)


# ---------------------------------------------------------------- D1 Gram

def gram_sql(df: DataFrame, col: str, d: int) -> DataFrame:
    """G = A^T A as one aggregate of d(d+1)/2 sums -> (i, j, value), i <= j."""
    c = V.q(col)
    sums = {f"g_{i}_{j}": f"{c}[{i}] * {c}[{j}]" for i in range(d) for j in range(i, d)}
    one = A.tree_agg(df, sums)
    stack = ", ".join(f"{i}, {j}, g_{i}_{j}" for i in range(d) for j in range(i, d))
    return one.selectExpr(f"stack({len(sums)}, {stack}) AS (i, j, value)")


def gram_arrow(df: DataFrame, col: str, d: int) -> DataFrame:
    """G = A^T A: one upper triangle per task, added as blocks."""
    iu, ju = np.triu_indices(d)

    def add(block, batch):
        X = batch_matrix(batch, col, d)
        block += (X.T @ X)[iu, ju]

    total = A.collect_block_sum(A.block_partials(df.select(col), len(iu), add), len(iu))
    import pandas as pd
    return _spark(df).createDataFrame(pd.DataFrame({"i": iu, "j": ju, "value": total}), "i int, j int, value double")


def gram(df: DataFrame, col: str = "features", d: int | None = None,
         method: str = "auto") -> DataFrame:
    """G = A^T A (D1) as upper-triangle cells ``(i int, j int, value double)``."""
    d = d or width(df, col)
    if method == "sql" or (method == "auto" and d <= GRAM_SQL_MAX):
        return gram_sql(df, col, d)
    return gram_arrow(df, col, d)


def cells_to_matrix(cells, d: int, symmetric: bool = True) -> np.ndarray:
    rows = cells.collect() if isinstance(cells, DataFrame) else cells
    G = np.zeros((d, d))
    for r in rows:
        G[int(r["i"]), int(r["j"])] = float(r["value"])
        if symmetric:
            G[int(r["j"]), int(r["i"])] = float(r["value"])
    return G


def gram_matrix(df: DataFrame, col: str = "features", d: int | None = None) -> np.ndarray:
    d = d or width(df, col)
    return cells_to_matrix(gram(df, col, d), d)


# ---------------------------------------------------------------- D2 TSQR

def canonical_r(R: np.ndarray) -> np.ndarray:
    """R with a non-negative diagonal (the unique R of a full-rank A)."""
    s = np.sign(np.diag(R))
    s[s == 0] = 1.0
    return R * s[:, None]


def _r_schema() -> T.StructType:
    return T.StructType([T.StructField("block", T.LongType()),
                         T.StructField("r", T.ArrayType(T.DoubleType()))])


def tsqr_r(df: DataFrame, col: str = "features", d: int | None = None,
           fan: int = TSQR_FAN) -> np.ndarray:
    """R of a communication-avoiding tall-skinny QR.

    Per partition a running R <- qr([R; batch]) over the Arrow batches (never
    the whole partition in memory), then a tree: the R factors of ``fan``
    neighbouring partitions are stacked and factored again, level by level,
    until at most ``fan`` (fan*d x d) are left for the driver. Canonical
    sign: positive diagonal.
    """
    d = d or width(df, col)
    ship_package(_spark(df))

    def local(batches):
        from pyspark import TaskContext
        R = None
        for b in batches:
            X = batch_matrix(b, col, d)
            if X.shape[0] == 0:
                continue
            R = np.linalg.qr(X if R is None else np.vstack([R, X]), mode="r")
        if R is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()),
                 pa.array([np.ascontiguousarray(R).ravel()], pa.list_(pa.float64()))],
                names=["block", "r"])

    def combine(pdf):
        import pandas as pd
        R = np.linalg.qr(np.vstack([np.asarray(r, dtype=float).reshape(-1, d) for r in pdf["r"]]), mode="r")
        return pd.DataFrame({"r": [np.ascontiguousarray(R).ravel()]})

    level = A.tree_levels(df.select(col).mapInArrow(local, _r_schema()), "block", "block long, r array<double>", combine, fan)
    parts = [np.asarray(r["r"], dtype=float).reshape(-1, d) for r in sorted(level.collect(), key=lambda r: r["block"])]
    forget(level)
    if not parts:
        raise ValueError("empty input")
    R = np.linalg.qr(np.vstack(parts), mode="r")
    if R.shape[0] < d:   # fewer rows than columns: pad to d x d
        R = np.vstack([R, np.zeros((d - R.shape[0], d))])
    return canonical_r(R)


# ---------------------------------------------------------------- D4-D6

def _inv_upper(R: np.ndarray, rcond: float = 1e-10) -> np.ndarray:
    """R^-1; raises where R is singular relative to its largest diagonal
    entry (A^T A then has no inverse and Q = A R^-1 is not defined)."""
    diag = np.abs(np.diag(R))
    if len(diag) and not diag.min() > rcond * diag.max():
        raise ValueError(f"R is singular: columns {np.flatnonzero(diag <= rcond * diag.max()).tolist()} "
                         "depend on the ones before them")
    return np.linalg.solve(R, np.eye(len(R)))


def thin_q(df: DataFrame, R: np.ndarray, col: str = "features", out: str = "q",
           keep: tuple[str, ...] = ("row_id",), refine: bool = False):
    """Explicit thin Q as rows, q = a R^-1 (D4). ``refine`` repeats the QR on
    Q once (CholeskyQR2-like) and returns the corrected R too."""
    Q = project_rows(df, col, _inv_upper(R), out=out, keep=keep)
    if not refine:
        return Q, R
    R2 = tsqr_r(Q, out, R.shape[0])
    Q2 = project_rows(Q, out, _inv_upper(R2), out=out, keep=keep)
    return Q2, R2 @ R


class QtX(NamedTuple):
    c: np.ndarray          # Q^T x, d coordinates
    residual: DataFrame    # keep + residual column: x - Q Q^T x


def apply_qt(df: DataFrame, R: np.ndarray, col: str = "features", x: str = "x",
             keep: tuple[str, ...] = ("row_id",)) -> QtX:
    """Q^T x with Q = A R^-1 implicit (D5): c = R^-T (A^T x) from one
    d-vector aggregate; the part of x outside range(A) stays a column
    r = x - a . (R^-1 c), so ||c||^2 + ||r||^2 = ||x||^2."""
    d = R.shape[0]
    atx = rmatvec(df, col, x, d)
    c = np.linalg.solve(R.T, atx)
    coef = np.linalg.solve(R, c)
    res = df.select(*keep, (F.col(x) - V.dot_const(col, coef)).alias("residual"))
    return QtX(c, res)


def apply_q(df: DataFrame, R: np.ndarray, c: np.ndarray, col: str = "features",
            residual: str = "residual", out: str = "x",
            keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Q c + r (D6), the inverse of ``apply_qt``: x = a . (R^-1 c) + r."""
    coef = np.linalg.solve(R, np.asarray(c, dtype=float))
    r = F.col(residual) if residual else F.lit(0.0)
    return df.select(*keep, (V.dot_const(col, coef) + r).alias(out))


# ---------------------------------------------------------------- D7, D8

class SVD(NamedTuple):
    s: np.ndarray          # singular values, descending
    V: np.ndarray          # d x k right singular vectors
    U: DataFrame | None    # keep + u array<double> (k entries)


def truncated_svd(df: DataFrame, k: int | None = None, col: str = "features",
                  rcond: float = 1e-9, compute_u: bool = True,
                  keep: tuple[str, ...] = ("row_id",)) -> SVD:
    """A = U S V^T from the d x d factor R of ``tsqr_r`` (D7): the SVD of R
    on the driver (R keeps the condition of A, the Gram matrix squares it),
    values under rcond * s_max dropped, U rows = a V S^-1 (narrow map)."""
    d = width(df, col)
    _, s, vt = np.linalg.svd(tsqr_r(df, col, d))
    keep_mask = s > rcond * (s[0] if len(s) else 0.0)
    s, vecs = s[keep_mask], vt.T[:, keep_mask]
    if k is not None:
        s, vecs = s[:k], vecs[:, :k]
    vecs = vecs * np.where(vecs[np.argmax(np.abs(vecs), axis=0), range(vecs.shape[1])] < 0,
                           -1.0, 1.0)   # sign: largest entry of each v positive
    U = project_rows(df, col, vecs / s, out="u", keep=keep) if compute_u else None
    return SVD(s, vecs, U)


def group_svd(cells: DataFrame, key: str, size_col: str = "m") -> DataFrame:
    """Many small SVDs, one per group (D8): input cells ``(key, i, j, value)``
    of an m x m matrix per group (m bounded by the caller); output
    ``(key, k, s, u array<double>)``: singular value k and column k of U."""
    ship_package(cells.sparkSession)
    key_type = cells.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type), T.StructField("k", T.IntegerType()),
                           T.StructField("s", T.DoubleType()),
                           T.StructField("u", T.ArrayType(T.DoubleType()))])

    def fn(kv, pdf):
        import pandas as pd
        m = int(max(pdf["i"].max(), pdf["j"].max())) + 1
        W = np.zeros((m, m))
        W[pdf["i"].to_numpy(), pdf["j"].to_numpy()] = pdf["value"].to_numpy()
        U, s, _ = np.linalg.svd(W)
        return pd.DataFrame({key: [kv[0]] * m, "k": np.arange(m, dtype=np.int32),
                             "s": s, "u": [U[:, c].copy() for c in range(m)]})

    return cells.groupBy(key).applyInPandas(fn, schema)


# ---------------------------------------------------------------- D10, D11

def matvec(df: DataFrame, w, col: str = "features", out: str = "y") -> DataFrame:
    """A w per row."""
    return df.withColumn(out, V.dot_const(col, w))


def rmatvec(df: DataFrame, col: str, x: str, d: int) -> np.ndarray:
    """A^T x as a d-vector (D10): d sums in one aggregate."""
    sums = A.collect_sums(df, {f"s{j}": f"{V.q(x)} * {V.q(col)}[{j}]" for j in range(d)})
    return np.array([sums[f"s{j}"] for j in range(d)])


def frobenius_norm(df: DataFrame, col: str = "features") -> DataFrame:
    """sqrt(sum of squares) of all entries of an array column."""
    sq = F.aggregate(F.col(col), F.lit(0.0), lambda acc, v: acc + v * v)
    return df.agg(F.sqrt(F.sum(sq)).alias("frobenius"))


def l1_norm(df: DataFrame, col: str) -> DataFrame:
    """sum |v| of a scalar column (D11; the norm1 of a column vector)."""
    return df.agg(F.sum(F.abs(F.col(col))).alias("l1"))

"""The few largest singular values and vectors of a wide matrix.

Block Lanczos: the Krylov space of A^T A from a random block of k + extra
vectors, fully reorthogonalised. A step is one pass over the rows that sums
X^T (X V) per Arrow batch; the driver holds d x (steps x block) numbers and
no d x d matrix is ever formed. The final values come from the triangular
factor of A times the found directions, so they keep A's own condition.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import aggregates as A
from . import linalg as L


def normal_product(df: DataFrame, v: np.ndarray, col: str = "features") -> np.ndarray:
    """A^T (A V): one pass, d x block sums."""
    d, p = v.shape

    def add(block, batch):
        X = L.batch_matrix(batch, col, d)
        block += (X.T @ (X @ v)).ravel()
    return A.collect_block_sum(A.block_partials(df.select(col), d * p, add), d * p).reshape(d, p)


def top_svd(df: DataFrame, k: int, col: str = "features", extra: int = 4, tol: float = 1e-10, max_steps: int = 60,
            seed: int = 42, keep: tuple[str, ...] = ("row_id",), compute_u: bool = True) -> L.SVD:
    """The ``k`` largest singular values, V (d x k) and U rows of A.

    Stops when the residual |A^T A v - s^2 v| of each is at most ``tol``
    times the largest s^2, or when the Krylov space is whole; raises if it
    is neither after ``max_steps``. Values that are zero are left out; of
    each v the largest entry is positive. An empty table raises."""
    row = df.selectExpr(f"size({col}) AS d").first()
    if row is None:
        raise ValueError("empty input")
    d = int(row["d"])
    if not 0 < k <= d:
        raise ValueError(f"{k} values of {d} columns")
    new = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, min(d, k + extra))))[0]
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    df = df.cache()
    try:
        for _ in range(max_steps):
            image = normal_product(df, new, col)
            basis, images = np.hstack([basis, new]), np.hstack([images, image])
            t = basis.T @ images
            values, y = np.linalg.eigh((t + t.T) / 2)
            values, y = values[::-1], y[:, ::-1]
            gap = np.linalg.norm(images @ y[:, :k] - basis @ y[:, :k] * values[:k], axis=0)
            rest = image
            for _again in range(2):     # twice is enough
                rest = rest - basis @ (basis.T @ rest)
            q, r = np.linalg.qr(rest)
            new = q[:, np.abs(np.diag(r)) > 1e-12 * max(values[0], 0.0)][:, :d - basis.shape[1]]
            if gap.max() <= tol * max(values[0], 0.0) or new.shape[1] == 0:
                break
            new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
        else:
            raise ValueError(f"not converged after {max_steps} steps")
        v = basis @ y[:, :k]
        r = L.tsqr_r(L.project_rows(df, col, v, out="_ks_y", keep=()), "_ks_y", v.shape[1])
        _, s, vt = np.linalg.svd(r)
        held = s > 1e-12 * max(s[0], 1e-300)
        s, v = s[held], (v @ vt.T)[:, held]
        v = v * np.where(v[np.argmax(np.abs(v), axis=0), range(v.shape[1])] < 0, -1.0, 1.0)
        u = L.project_rows(df, col, v / s, out="u", keep=keep) if compute_u else None
        return L.SVD(s, v, u)
    finally:
        df.unpersist()

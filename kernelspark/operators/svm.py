"""Squared-hinge SVM trained in Spark.

Problem (bias penalised, a_i = y_i (x_i, 1)):

    min_alpha>=0  1/2 alpha^T H alpha - e^T alpha,   H = A A^T + I/(2C)

Dual ascent on the multiplier beta of alpha >= 0, as in the reference:

    alpha = H^-1 (e + beta),   beta <- max(0, beta - step * alpha)

The n x n solve is done in the natural space with the Woodbury identity:
M = A^T A + I/(2C) is d x d and factored once on the driver;
u = A^T (e + beta) is one d-vector aggregate; v = M^-1 u;
alpha_i = 2C ((1 + beta_i) - a_i . v). One Spark job per iteration updates
beta, emits the error sum |beta_new - beta| and the next u in the same pass.
The model is w = A^T alpha = v (last entry: bias weight).

State: the signed design rows are written once as blocks; beta is replayed
from the last checkpoint of it in ``spark.checkpoint.dir`` (one every
``checkpoint_every`` iterations), so a lost executor replays at most that many
steps from shared storage.

``solver='newton'`` (an addition) minimises the primal twin
1/2 ||w||^2 + C sum max(0, 1 - a_i . w)^2 by finite Newton steps with
step halving: one aggregate of masked Gram sums per pass, same optimum.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import ship_package
from . import aggregates as A
from . import dual
from . import linalg as L


class SVMModel(NamedTuple):
    weights: list[float]        # w; the last entry is the bias weight
    history: DataFrame          # (iteration int, error double)
    state: DataFrame | None     # (row_id, alpha, beta) of the last iteration
    iterations: int
    converged: bool
    solver: str
    history_rows: list          # the same history on the driver (<= max_iter rows)
    weights_path: list | None = None   # w after each iteration (<= max_iter x d)


def step_size(C: float, learn_rate: float) -> float:
    """(floor(1/(lr C)) - 0.5) lr (G1); must lie in (0, 1/C)."""
    step = (math.floor(1.0 / (learn_rate * C)) - 0.5) * learn_rate
    if not (0.0 < step < 1.0 / C):
        raise ValueError(f"step {step} outside (0, 1/C): learn_rate * C must be <= 1")
    return step


def design_columns(d: int) -> list[str]:
    return [f"a_{j}" for j in range(d)]


def signed_design(rows: DataFrame, features: str = "features", label: str = "label",
                  d: int | None = None, row_id: str = "row_id") -> tuple[DataFrame, int]:
    """a = y (x, 1) flattened to ``a_0..a_{D-1}`` (B1 + B2), D = d + 1."""
    d = d or L.width(rows, features)
    y = F.col(label).cast("double")
    # get(): a short row yields null here and is reported by the width check
    cols = [(y * F.get(F.col(features), j)).alias(f"a_{j}") for j in range(d)] + [y.alias(f"a_{d}")]
    width_ok = F.coalesce(F.size(features) == F.lit(d), F.lit(False))
    label_ok = F.coalesce(F.abs(y) == F.lit(1.0), F.lit(False))
    entries_ok = ~F.coalesce(F.exists(features, lambda x: x.isNull() | F.isnan(x)), F.lit(False))
    flag = lambda ok: F.when(ok, F.lit(0)).otherwise(F.lit(1))
    checked = rows.select(F.col(row_id).alias("row_id"), *cols, flag(width_ok).alias("_bad"),
                          flag(label_ok).alias("_bad_label"), flag(entries_ok).alias("_bad_entry"))
    return checked, d + 1


BAD_ROWS = {"_bad": "do not have the width of the first row", "_bad_label": "have a label other than +1 and -1",
            "_bad_entry": "have a null or NaN entry"}


def _raise_on_bad_rows(counts: dict[str, float]) -> None:
    for bad, what in BAD_ROWS.items():
        if counts[bad] > 0:
            raise ValueError(f"{int(counts[bad])} rows {what}")


def _persist(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def fit_svm(rows: DataFrame, C: float = 1.0, learn_rate: float = 0.2, max_iter: int = 500,
            tol: float = 1e-3, tol_mode: str = "l1", solver: str = "dual_ascent",
            features: str = "features", label: str = "label",
            checkpoint_every: int = 25, num_partitions: int | None = None, resume_dir: str | None = None) -> SVMModel:
    """Train the squared-hinge SVM (G6) on ``(row_id, features, label)`` rows.

    ``resume_dir`` (dual ascent): a shared folder that keeps the run's steps;
    a fit that is called again with it goes on behind the last finished step.

    In dual ascent beta is a deterministic function of the rows and the
    d-vectors v used so far. Checkpoints hold beta alone; each iteration
    replays the steps since the last one in numpy over blocks of rows and
    returns partial sums only (see ``dual``). Rows of another width, with
    labels other than +1 and -1 or with null or NaN entries raise.
    """
    if solver not in ("dual_ascent", "newton"):
        raise ValueError(f"unknown solver {solver!r}")
    if tol_mode not in ("l1", "mean"):
        raise ValueError(f"unknown tol_mode {tol_mode!r}")
    spark = rows.sparkSession
    ship_package(spark)
    design, D = signed_design(rows, features, label)
    # The design is cached in the partitions of its input and scanned once per
    # iteration; only a caller that asks for a number gets a shuffle.
    if num_partitions:
        design = design.repartition(num_partitions)
    cached = design = _persist(design)
    try:
        a = [F.col(c) for c in design_columns(D)]
        # one pass: u for beta = 1, row count, width check (+ the Gram for small D)
        sums = {f"u{j}": f"a_{j} * 2.0D" for j in range(D)}
        sums["n"] = "1.0D"
        for bad in BAD_ROWS:
            sums[bad] = f"CAST({bad} AS DOUBLE)"
        wide = D > L.GRAM_SQL_MAX
        if not wide:
            sums.update({f"g_{i}_{j}": f"a_{i} * a_{j}" for i in range(D) for j in range(i, D)})
        tot = A.collect_sums(design, sums)
        _raise_on_bad_rows(tot)
        n = tot["n"]
        if wide:   # numpy partials per partition, summed by cell
            G = L.gram_matrix(design.select(F.array(*a).alias("_a")), "_a", D)
        else:
            G = np.zeros((D, D))
            for i in range(D):
                for j in range(i, D):
                    G[i, j] = G[j, i] = tot[f"g_{i}_{j}"]
        if solver == "newton":
            col_sums = np.array([tot[f"u{j}"] for j in range(D)]) / 2.0
            return _fit_newton(design, G, col_sums, D, C, max_iter, tol, spark)

        step = step_size(C, learn_rate)
        M = G + np.eye(D) / (2.0 * C)
        Lc = np.linalg.cholesky(M)
        u = np.array([tot[f"u{j}"] for j in range(D)])
        run = dual.run(spark, design.select(F.col("row_id").cast("long").alias("row_id"), *a), D, u, Lc, dual.Steps(
            C, step, max_iter, tol * (n if tol_mode == "mean" else 1.0), checkpoint_every or max_iter + 1), resume_dir)
        history = [(t, e / n if tol_mode == "mean" else e) for t, e in run.history]
        return SVMModel(run.path[-1], spark.createDataFrame(history, "iteration int, error double"), run.state, len(history),
                        run.converged, "dual_ascent", history, run.path)
    finally:
        cached.unpersist()


def design_blocks(design: DataFrame, D: int) -> DataFrame:
    """The design as one binary block ``x`` (rows x D doubles) per Arrow
    batch, for passes that read all of it again and again."""
    cols = design_columns(D)

    def pack(batches):
        import pyarrow as pa
        for b in batches:
            if b.num_rows:
                X = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(D)])
                yield pa.RecordBatch.from_arrays([pa.array([X.tobytes()], pa.binary())], names=["x"])

    return design.select(*cols).mapInArrow(pack, "x binary")


def unpack_blocks(batch, D: int):
    """The rows x D arrays of a batch of ``design_blocks``."""
    for x in batch.column(0):
        yield np.frombuffer(x.as_buffer(), dtype=np.float64).reshape(-1, D)


def _newton_partials(blocks: DataFrame, D: int, w: np.ndarray):
    """(obj, g, H) sums over active rows: one numpy block per task (objective,
    gradient, upper triangle), added as blocks. The weights travel with
    the function, so no pass compiles code of its own."""
    iu, ju = np.triu_indices(D)
    k = 1 + D + len(iu)

    def add(block, b):
        for X in unpack_blocks(b, D):
            r = 1.0 - X @ w
            act = r > 0
            Xa, ra = X[act], r[act]
            block[0] += ra @ ra
            block[1:1 + D] += Xa.T @ ra
            block[1 + D:] += (Xa.T @ Xa)[iu, ju]

    tot = A.collect_block_sum(A.block_partials(blocks, k, add), k)
    H = np.zeros((D, D))
    H[iu, ju] = H[ju, iu] = tot[1 + D:]
    return tot[0], tot[1:1 + D], H


def _fit_newton(design: DataFrame, G: np.ndarray, col_sums: np.ndarray, D: int,
                C: float, max_iter: int,
                tol: float, spark) -> SVMModel:
    """Finite Newton on 1/2||w||^2 + C sum max(0, 1 - a.w)^2 (primal twin).

    Each pass is one aggregate over the cached design: the objective,
    gradient and Hessian sums over the rows with a positive hinge residual."""
    a = [F.col(c) for c in design_columns(D)]
    blocks = _persist(design_blocks(design, D))

    def evaluate(w):
        o, gs, Hs = _newton_partials(blocks, D, w)
        return 0.5 * float(w @ w) + C * o, w - 2.0 * C * gs, np.eye(D) + 2.0 * C * Hs

    # start from the least-squares-like point with every row active
    w = np.linalg.solve(np.eye(D) + 2.0 * C * G, 2.0 * C * col_sums)
    obj, grad, H = evaluate(w)
    history, converged, it = [(0, float(np.abs(grad).max()))], False, 0
    for it in range(1, max_iter + 1):
        if np.abs(grad).max() < tol * max(1.0, np.abs(w).max()):
            converged = True
            break
        direction = np.linalg.solve(H, grad)
        t = 1.0
        while True:
            cand = w - t * direction
            c_obj, c_grad, c_H = evaluate(cand)
            if c_obj <= obj + 1e-12 * abs(obj) or t < 1e-8:
                break
            t *= 0.5
        w, obj, grad, H = cand, c_obj, c_grad, c_H
        history.append((it, float(np.abs(grad).max())))
    blocks.unpersist()
    state = design.select("row_id", (F.lit(2.0 * C) * F.greatest(
        F.lit(1.0) - V.linear_terms(a, w), F.lit(0.0))).alias("alpha"),
        F.lit(0.0).alias("beta"))
    hist_df = spark.createDataFrame(history, "iteration int, error double")
    return SVMModel([float(x) for x in w], hist_df, state, it, converged, "newton", history)


def fit_newton_cg(rows: DataFrame, C: float = 1.0, max_iter: int = 100, tol: float = 1e-6, max_cg: int = 200,
                  features: str = "features", label: str = "label", num_partitions: int | None = None) -> SVMModel:
    """The primal twin by truncated Newton steps without a matrix: directions
    come from conjugate gradients, whose products H v = v + 2C sum over active
    rows of a (a . v) are one pass and one d-vector sum each. Tasks and the
    driver hold vectors of d only, at any width. Wrong rows raise as in
    ``fit_svm``."""
    spark = rows.sparkSession
    ship_package(spark)
    design, D = signed_design(rows, features, label)
    if num_partitions:
        design = design.repartition(num_partitions)
    blocks = None
    try:
        design = _persist(design)
        _raise_on_bad_rows(A.collect_sums(design, {b: f"CAST({b} AS DOUBLE)" for b in BAD_ROWS}))
        blocks = _persist(design_blocks(design, D))

        def evaluate(w):
            """Objective, gradient and the Hessian's diagonal."""
            def add(block, b):
                for X in unpack_blocks(b, D):
                    r = np.maximum(1.0 - X @ w, 0.0)
                    block[0] += r @ r
                    block[1:1 + D] += X.T @ r
                    block[1 + D:] += (X * X).T @ (r > 0)
            s = A.collect_block_sum(A.block_partials(blocks, 1 + 2 * D, add), 1 + 2 * D)
            return 0.5 * float(w @ w) + C * s[0], w - 2.0 * C * s[1:1 + D], 1.0 + 2.0 * C * s[1 + D:]

        def product(w, v):
            def add(block, b):
                for X in unpack_blocks(b, D):
                    block += X.T @ np.where(X @ w < 1.0, X @ v, 0.0)
            return v + 2.0 * C * A.collect_block_sum(A.block_partials(blocks, D, add), D)

        w = np.zeros(D)
        obj, grad, diag = evaluate(w)
        history, converged, it = [(0, float(np.abs(grad).max()))], False, 0
        for it in range(1, max_iter + 1):
            if np.abs(grad).max() < tol * max(1.0, np.abs(w).max()):
                converged = True
                break
            # preconditioned by the diagonal, to a share of the gradient that shrinks with it
            goal = min(0.1, np.sqrt(np.linalg.norm(grad) / max(1.0, abs(obj)))) * np.sqrt(grad @ (grad / diag))
            x, r = np.zeros(D), grad.copy()
            z = r / diag
            p, rz = z.copy(), r @ z
            for _ in range(max_cg):
                hp = product(w, p)
                step = rz / (p @ hp)
                x, r = x + step * p, r - step * hp
                z = r / diag
                rz, old = r @ z, rz
                if np.sqrt(rz) <= goal:
                    break
                p = z + (rz / old) * p
            t = 1.0
            while True:
                cand = w - t * x
                c_obj, c_grad, c_diag = evaluate(cand)
                if c_obj <= obj - 1e-4 * t * float(grad @ x) or t < 1e-8:
                    break
                t *= 0.5
            w, obj, grad, diag = cand, c_obj, c_grad, c_diag
            history.append((it, float(np.abs(grad).max())))
        state = design.select("row_id", (F.lit(2.0 * C) * F.greatest(
            F.lit(1.0) - V.linear_terms([F.col(c) for c in design_columns(D)], w), F.lit(0.0))).alias("alpha"), F.lit(0.0).alias("beta"))
        return SVMModel([float(x) for x in w], spark.createDataFrame(history, "iteration int, error double"), state, it, converged,
                        "newton_cg", history)
    finally:
        design.unpersist()
        if blocks is not None:
            blocks.unpersist()


# ---------------------------------------------------------------- scoring

def decision(df: DataFrame, weights, features: str = "features", out: str = "margin",
             with_bias: bool = True) -> DataFrame:
    """m = w . (x, 1) (B12): a pure column expression (works on streams too)."""
    w = list(weights)
    if with_bias:
        m = V.dot_const(features, w[:-1]) + F.lit(float(w[-1]))
    else:
        m = V.dot_const(features, w)
    return df.withColumn(out, m)


def predict(df: DataFrame, weights, features: str = "features", out: str = "prediction",
            margin: str = "margin") -> DataFrame:
    """+1 if the margin is > 0, else -1; a tie is negative."""
    scored = decision(df, weights, features, margin)
    return scored.withColumn(out, F.when(F.col(margin) > F.lit(0.0), F.lit(1.0))
                             .otherwise(F.lit(-1.0)))


def evaluate(df: DataFrame, weights, features: str = "features", label: str = "label") -> DataFrame:
    """B12 + B13 + E3 + E4 in one aggregate."""
    return A.confusion(predict(df, weights, features), "prediction", label)


def weights_from_alpha(df: DataFrame, alpha: str = "alpha", features: str = "features",
                       label: str = "label", d: int | None = None) -> np.ndarray:
    """w = A^T alpha = sum_i alpha_i y_i (x_i, 1)."""
    d = d or L.width(df, features)
    sums = {f"w{j}": F.col(alpha) * F.col(label) * V.item(features, j) for j in range(d)}
    sums["w_bias"] = F.col(alpha) * F.col(label)
    s = A.collect_sums(df, sums)
    return np.array([s[f"w{j}"] for j in range(d)] + [s["w_bias"]])


def kkt_report(state: DataFrame, rows: DataFrame, weights, C: float,
               features: str = "features", label: str = "label") -> DataFrame:
    """Distance from the optimum conditions (G9): at the optimum
    alpha_i = 2C max(0, 1 - m_i) with m_i = y_i w.(x_i, 1), beta >= 0."""
    scored = decision(rows, weights, features).select(
        "row_id", (F.col(label) * F.col("margin")).alias("m"))
    j = state.join(scored, "row_id")
    target = F.lit(2.0 * C) * F.greatest(F.lit(1.0) - F.col("m"), F.lit(0.0))
    return j.agg(F.max(F.abs(F.col("alpha") - target)).alias("max_alpha_gap"),
                 F.min("beta").alias("min_beta"),
                 F.count_if(F.col("alpha") > F.lit(1e-3)).alias("n_support"))

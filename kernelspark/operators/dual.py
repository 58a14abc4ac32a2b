"""The dual ascent's iterations (G2-G5), restartable.

With M = A^T A + I/2C factored once, step t solves M v_t = u_t, where
u_t = A^T (1 + beta_{t-1}); beta_t = max(0, beta_{t-1} - step * alpha_t) with
alpha_t = 2C ((1 + beta_{t-1}) - A v_t). So beta_t follows from beta_s and
v_{s+1}..v_t. A run keeps in its folder

* ``design``: the signed rows, once, as numbered blocks of rows x d doubles;
* ``step-t``: v_t, the step's error and the next u, written and renamed in
  place when the step is done;
* ``beta-t``: (block, beta) every so many steps, 8 bytes a row whatever d is.

An iteration reads the blocks, joined with the last beta by their numbers,
replays the steps since then and returns d + 1 sums; it writes one small
file. A run that is started again in its folder goes on behind its last step
with the same numbers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, names_in, read_text, remove_folder, stored, write_text
from . import aggregates as A


class Steps(NamedTuple):
    C: float
    step: float
    max_iter: int
    tol: float              # of the L1 change of beta
    every: int              # steps between checkpoints


class Run(NamedTuple):
    path: list[list[float]]             # v after each step
    history: list[tuple[int, float]]    # (step, L1 change of beta)
    state: DataFrame                    # row_id, alpha, beta after the last step
    converged: bool


def _write_design(rows: DataFrame, D: int, path: str) -> None:
    """Rows (row_id, a_0..) as blocks: block, ids, x. Complete when its marker is there."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            if b.num_rows:
                x = np.column_stack([b.column(j).to_numpy(zero_copy_only=False) for j in range(1, D + 1)])
                ids = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), b.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, pa.array([x.tobytes()], pa.binary())], ["block", "ids", "x"])
                number += 1
    rows.mapInArrow(pack, "block long, ids array<long>, x binary").write.mode("overwrite").parquet(path)


def _replayed(batch: pa.RecordBatch, D: int, s: Steps, vs: np.ndarray) -> Iterator[tuple]:
    """(place in the batch, rows x D, beta, alpha, change) of its blocks after the steps ``vs``."""
    x_at, beta_at = (batch.schema.get_field_index(c) for c in ("x", "beta"))
    for k in range(batch.num_rows):
        X = np.frombuffer(batch.column(x_at)[k].as_buffer(), dtype=np.float64).reshape(-1, D)
        beta = np.ones(len(X)) if beta_at < 0 else np.frombuffer(batch.column(beta_at)[k].as_buffer(), dtype=np.float64)
        alpha = change = np.zeros(len(X))
        for v in vs:
            alpha = 2.0 * s.C * ((1.0 + beta) - X @ v)
            new = np.maximum(beta - s.step * alpha, 0.0)
            beta, change = new, np.abs(new - beta)
        yield k, X, beta, alpha, change


def _sums(blocks: DataFrame, D: int, s: Steps, vs: np.ndarray) -> np.ndarray:
    """u = A^T (1 + beta) after the steps, and the last one's change."""
    def add(total, batch):
        for _, X, beta, _, change in _replayed(batch, D, s, vs):
            total[:D] += X.T @ (1.0 + beta)
            total[D] += change.sum()
    return A.collect_block_sum(A.block_partials(blocks.drop("ids"), D + 1, add), D + 1)


def _betas(blocks: DataFrame, D: int, s: Steps, vs: np.ndarray) -> DataFrame:
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            beta = [x[2].tobytes() for x in _replayed(b, D, s, vs)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("block")), pa.array(beta, pa.binary())], ["block", "beta"])
    return blocks.mapInArrow(fn, "block long, beta binary")


def _state(blocks: DataFrame, D: int, s: Steps, vs: np.ndarray) -> DataFrame:
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids"))
            for k, _, beta, alpha, _ in _replayed(b, D, s, vs):
                yield pa.RecordBatch.from_arrays([ids[k].values, pa.array(alpha), pa.array(beta)], ["row_id", "alpha", "beta"])
    return blocks.mapInArrow(fn, "row_id long, alpha double, beta double")


def run(spark: SparkSession, rows: DataFrame, D: int, u: np.ndarray, Lc: np.ndarray, s: Steps, folder: str | None = None) -> Run:
    """Steps until the change of beta is below ``s.tol``. ``rows``: row_id and
    a_0..; ``u`` the sums for beta = 1; ``Lc`` the Cholesky factor of M. With a
    ``folder`` the run can be started again and is kept; else it is removed."""
    own = folder is None
    folder = folder or f"{checkpoint_dir(spark)}/svm-{uuid.uuid4().hex}"
    # what a run depends on: the settings and the rows, by their sums
    about = json.dumps({"C": s.C, "step": s.step, "u": [float(f"{x:.6g}") for x in u], "m": float(f"{np.abs(Lc).sum():.6g}")})
    before = read_text(spark, f"{folder}/run.json")
    if before is None:
        _write_design(rows, D, f"{folder}/design")
        write_text(spark, f"{folder}/run.json", about)
    elif before != about:
        raise ValueError(f"{folder} holds a run of other rows or settings")
    schema = "block long, ids array<long>, x binary"
    design = spark.read.schema(schema).parquet(f"{folder}/design").repartition("block").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        path, history, base = [], [], 0
        names = names_in(spark, folder)
        while f"step-{len(path) + 1:06d}" in names:
            one = json.loads(read_text(spark, f"{folder}/step-{len(path) + 1:06d}"))
            path.append(one["v"])
            history.append((len(path), one["error"]))
            u = np.array(one["u"])
        for t in range(1, len(path) + 1):
            if f"beta-{t:06d}.done" in names:
                base = t

        def blocks() -> DataFrame:
            if not base:
                return design
            beta = spark.read.schema("block long, beta binary").parquet(f"{folder}/beta-{base:06d}")
            return design.join(beta, "block")

        def since() -> np.ndarray:
            return np.array(path[base:]).reshape(-1, D)

        while not (history and history[-1][1] < s.tol) and len(path) < s.max_iter:
            v = np.linalg.solve(Lc.T, np.linalg.solve(Lc, u))
            path.append(v.tolist())
            t = len(path)
            sums = _sums(blocks(), D, s, since())
            u = sums[:D]
            history.append((t, float(sums[D])))
            write_text(spark, f"{folder}/step-{t:06d}", json.dumps({"v": path[-1], "error": float(sums[D]), "u": u.tolist()}))
            if t - base >= s.every and t < s.max_iter and history[-1][1] >= s.tol:
                _betas(blocks(), D, s, since()).write.mode("overwrite").parquet(f"{folder}/beta-{t:06d}")
                write_text(spark, f"{folder}/beta-{t:06d}.done", "")
                if base:
                    remove_folder(spark, f"{folder}/beta-{base:06d}.done")
                    remove_folder(spark, f"{folder}/beta-{base:06d}")
                base = t
        if base == len(path):       # alpha is that of the last step, which has to be replayed
            base = 0
        state = stored(_state(blocks(), D, s, since()), "svm-state")
        return Run(path, history, state, bool(history) and history[-1][1] < s.tol)
    finally:
        design.unpersist()
        if own:
            remove_folder(spark, folder)

"""Matrices that are too wide for one task, as tables of square tiles.

A symmetric d x d matrix is its upper tiles ``(i int, j int, v binary)``,
``tile`` x ``tile`` doubles each (the last row and column of tiles may be
smaller). A vector is segments ``(i int, v binary)``. Tasks hold a few tiles,
the driver one; the steps of the factorisation are d / tile jobs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, ship_package, stored
from .linalg import batch_matrix

#: Side of a tile, and partial sums of a tile that meet first.
TILE, SALTS = 1024, 64


def _bytes(m: np.ndarray) -> bytes:
    return np.ascontiguousarray(m, dtype=np.float64).tobytes()


def _tile(b, rows: int) -> np.ndarray:
    return np.frombuffer(b, dtype=np.float64).reshape(rows, -1)


def _sides(d: int, tile: int) -> list[int]:
    return [min(tile, d - k) for k in range(0, d, tile)]


def _map(df: DataFrame, schema: str, row) -> DataFrame:
    """``row(dict of the row's values) -> dict`` over rows that hold tiles,
    one at a time."""
    ship_package(df.sparkSession)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                out = row({n: b.column(c)[k].as_py() for c, n in enumerate(b.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array([out["i"]], pa.int32()), *([pa.array([out["j"]], pa.int32())] if "j" in out else []),
                                                  pa.array([out["v"]], pa.binary())], names=list(out))
    return df.mapInArrow(fn, schema)


def sum_runs(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the blocks ``v`` (binary doubles) of equal int ``keys``: equal
    keys come as a sorted run and are added as they stream by."""
    ship_package(df.sparkSession)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def out():
            return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int32()) for k in key], pa.array([_bytes(total)], pa.binary())], names=[*keys, "v"])
        for b in batches:
            for r in range(b.num_rows):
                here = tuple(b.column(c)[r].as_py() for c in range(len(keys)))
                v = np.frombuffer(b.column(len(keys))[r].as_py(), dtype=np.float64)
                if here != key:
                    if key is not None:
                        yield out()
                    key, total = here, v.copy()
                else:
                    total += v
        if key is not None:
            yield out()

    ordered = df.select(*keys, "v").repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(fn, ", ".join(f"{k} int" for k in keys) + ", v binary")


def _sum_partials(df: DataFrame, keys: list[str]) -> DataFrame:
    """Partial tiles of all batches, first by salt, so that a tile's partials
    never meet in one task alone."""
    return sum_runs(sum_runs(df, [*keys, "salt"]), keys)


def tiled_gram(df: DataFrame, d: int, col: str = "features", tile: int = TILE) -> DataFrame:
    """G = A^T A as upper tiles. Every Arrow batch gives its product tile by
    tile, and tiles meet through the shuffle. Rows of another width raise; an
    empty table gives no tiles."""
    ship_package(df.sparkSession)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        salt = TaskContext.get().partitionId() % SALTS
        for b in batches:
            X = batch_matrix(b, col, d)
            for i in range(0, d, tile) if len(X) else ():
                left = X[:, i:i + tile].T
                for j in range(i, d, tile):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x], pa.int32()) for x in (i // tile, j // tile, salt)]
                        + [pa.array([_bytes(left @ X[:, j:j + tile])], pa.binary())], names=["i", "j", "salt", "v"])
    return _sum_partials(df.select(col).mapInArrow(fn, "i int, j int, salt int, v binary"), ["i", "j"])


def tiled_rmatvec(df: DataFrame, x: str, d: int, col: str = "features", tile: int = TILE) -> DataFrame:
    """A^T x for a double column, as segments."""
    ship_package(df.sparkSession)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        salt = TaskContext.get().partitionId() % SALTS
        for b in batches:
            X, y = batch_matrix(b, col, d), b.column(1).to_numpy(zero_copy_only=False)
            for i in range(0, d, tile) if len(X) else ():
                yield pa.RecordBatch.from_arrays([pa.array([i // tile], pa.int32()), pa.array([salt], pa.int32()),
                                                  pa.array([_bytes(y @ X[:, i:i + tile])], pa.binary())], names=["i", "salt", "v"])
    return _sum_partials(df.select(col, F.col(x).cast("double")).mapInArrow(fn, "i int, salt int, v binary"), ["i"])


def cells(tiles: DataFrame, d: int, tile: int = TILE) -> DataFrame:
    """The upper cells ``(i int, j int, value double)`` of tiles."""
    sides = _sides(d, tile)
    ship_package(tiles.sparkSession)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                i, j = b.column(0)[r].as_py(), b.column(1)[r].as_py()
                t = _tile(b.column(2)[r].as_py(), sides[i])
                a, c = np.triu_indices(len(t), 0, t.shape[1]) if i == j else (x.ravel() for x in np.indices(t.shape))
                yield pa.RecordBatch.from_arrays([pa.array(a + i * tile, pa.int32()), pa.array(c + j * tile, pa.int32()), pa.array(t[a, c])],
                                                 names=["i", "j", "value"])
    return tiles.select("i", "j", "v").mapInArrow(fn, "i int, j int, value double")


def add_ridge(tiles: DataFrame, ridge: float, d: int, tile: int = TILE) -> DataFrame:
    """Tiles of G + ridge I."""
    sides = _sides(d, tile)

    def row(r):
        if r["i"] != r["j"]:
            return r
        return {**r, "v": _bytes(_tile(r["v"], sides[r["i"]]) + ridge * np.eye(sides[r["i"]]))}
    return _map(tiles.select("i", "j", "v"), "i int, j int, v binary", row)


def tiled_cholesky(tiles: DataFrame, d: int, tile: int = TILE) -> DataFrame:
    """Upper tiles of R with R^T R = G, tile row by tile row: the diagonal
    tile is factored (on the driver, the one tile it ever holds), its row is
    solved against it, and every tile below is updated by two tiles of that
    row, which it meets by equi-joins. Raises where G is not positive
    definite."""
    sides = _sides(d, tile)
    rest, rows = stored(tiles.select("i", "j", "v"), "tiles"), []
    for k, side in enumerate(sides):
        first = rest.where(f"i = {k} AND j = {k}").first()
        try:
            r_kk = np.linalg.cholesky(_tile(bytes(first["v"]), side)).T
        except np.linalg.LinAlgError:
            raise ValueError(f"not positive definite in columns {k * tile} to {k * tile + side - 1}") from None

        def solve(r, k=k, r_kk=r_kk, side=side):
            v = r_kk if r["j"] == k else np.linalg.solve(r_kk.T, _tile(r["v"], side))
            return {"i": k, "j": r["j"], "v": _bytes(v)}

        row = stored(_map(rest.where(f"i = {k}"), "i int, j int, v binary", solve), "tiles")
        rows.append(row)
        if k + 1 < len(sides):
            left = row.select(F.col("j").alias("i"), F.col("v").alias("a"))
            right = row.select("j", F.col("v").alias("b"))

            def update(r, side=side):
                v = _tile(r["v"], sides[r["i"]]) - _tile(r["a"], side).T @ _tile(r["b"], side)
                return {"i": r["i"], "j": r["j"], "v": _bytes(v)}
            below = rest.where(f"i > {k}").join(left, "i").join(right, "j").select("i", "j", "v", "a", "b")
            after = stored(_map(below, "i int, j int, v binary", update), "tiles")
        forget(rest)
        rest = after if k + 1 < len(sides) else None
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def tiled_solve(r: DataFrame, b: DataFrame, d: int, tile: int = TILE) -> DataFrame:
    """z with R^T R z = b as segments, from upper tiles of R and segments of
    b: one segment at a time is solved, and the others are updated by the
    tiles they meet."""
    sides = _sides(d, tile)
    parts = []
    for forward in (True, False):
        rest = stored(b.select("i", "v"), "segments")
        solved = []
        for k in range(len(sides)) if forward else reversed(range(len(sides))):
            r_kk = _tile(bytes(r.where(f"i = {k} AND j = {k}").first()["v"]), sides[k])
            seg = np.frombuffer(bytes(rest.where(f"i = {k}").first()["v"]), dtype=np.float64)
            x = np.linalg.solve(r_kk.T if forward else r_kk, seg)
            solved.append((k, _bytes(x)))
            near = r.where(f"i = {k} AND j > {k}").select(F.col("j").alias("i"), F.col("v").alias("a")) if forward else \
                r.where(f"j = {k} AND i < {k}").select("i", F.col("v").alias("a"))

            def update(row, x=x, k=k, forward=forward):
                t = _tile(row["a"], sides[k] if forward else sides[row["i"]])
                return {"i": row["i"], "v": _bytes(np.frombuffer(row["v"], dtype=np.float64) - (t.T @ x if forward else t @ x))}
            after = stored(_map(rest.join(near, "i").select("i", "v", "a"), "i int, v binary", update), "segments")
            forget(rest)
            rest = after
        forget(rest)
        b = r.sparkSession.createDataFrame(solved, "i int, v binary")
        parts = solved
    return r.sparkSession.createDataFrame(parts, "i int, v binary")


def segment_values(segments: DataFrame, tile: int = TILE) -> DataFrame:
    """``(pos int, value double)`` of segments."""
    ship_package(segments.sparkSession)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                v = np.frombuffer(b.column(1)[r].as_py(), dtype=np.float64)
                at = b.column(0)[r].as_py() * tile
                yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(v)), pa.int32()), pa.array(v)], names=["pos", "value"])
    return segments.select("i", "v").mapInArrow(fn, "pos int, value double")

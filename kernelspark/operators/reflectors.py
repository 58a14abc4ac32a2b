"""QR by Householder reflectors kept as tables, and products with its Q.

``factor`` cuts the rows into blocks and reduces them in a tree: a block's QR
gives its reflectors in compact form (V, T; Q = I - V T V^T) and a small R,
and the R factors of up to ``fan`` children are stacked and factored again.
``qt`` takes a column up the tree, ``q`` takes coordinates down. Both are
products of reflectors, so they keep norms for any matrix, also a singular
or badly scaled one, for which A R^-1 does not exist.

The tree follows from the blocks' numbers alone. No task holds more than a
block or ``fan`` small factors; the driver receives R and d coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import forget, ship_package, stored
from .linalg import _arrow_type, batch_matrix, canonical_r, width

#: Rows of a leaf block, and children of a node of the tree.
BLOCK_ROWS, FAN = 4096, 32


# ---------------------------------------------------------------- one block

def block_qr(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(V, T, R) of m = (I - V T V^T) [R; 0]; R has min(rows, columns) rows."""
    h, tau = np.linalg.qr(m, mode="raw")
    h = h.T
    k = min(m.shape)
    v = np.tril(h[:, :k], -1)
    v[np.arange(k), np.arange(k)] = 1.0
    g = v.T @ v
    t = np.zeros((k, k))
    for j in range(k):
        t[:j, j] = -tau[j] * (t[:j, :j] @ g[:j, j])
        t[j, j] = tau[j]
    return v, t, np.triu(h[:k])


def turn(v: np.ndarray, t: np.ndarray, x: np.ndarray, up: bool) -> np.ndarray:
    """Q^T x (``up``) or Q x of a block."""
    return x - v @ ((t.T if up else t) @ (v.T @ x))


def _pack(m: np.ndarray) -> bytes:
    return np.ascontiguousarray(m, dtype=np.float64).tobytes()


def _unpack(b: bytes, rows: int | None = None) -> np.ndarray:
    x = np.frombuffer(b, dtype=np.float64)
    return x if rows is None else x.reshape(rows, -1) if rows else x.reshape(0, 0)


# ---------------------------------------------------------------- the tree

class Factor(NamedTuple):
    leaves: DataFrame           # a, b (block number), n, v, t, the kept columns as arrays
    levels: list[DataFrame]     # per level: a, b, v, t, children's a, b and heights
    shape: list[tuple[int, int]]    # per level: divisors of (a, b) that give the parent
    r: np.ndarray               # R of the root, canonical sign, d x d
    signs: np.ndarray           # signs that make it canonical
    keep: tuple[str, ...]

    def drop(self) -> None:
        """Remove the factor's tables."""
        forget(self.leaves, *self.levels)


_NODE = "a long, b long, k int, v binary, t binary, ca array<long>, cb array<long>, ck array<int>"


def _shape(most_a: int, most_b: int, fan: int) -> list[tuple[int, int]]:
    """Divisors of each level: first the blocks of a task meet, then tasks."""
    out, a, b = [], 1, 1
    while most_b // b or most_a // a or not out:
        if most_b // b:
            b *= fan
        else:
            a *= fan
        out.append((a, b))
    return out


def factor(df: DataFrame, col: str = "features", keep: tuple[str, ...] = ("row_id",),
           block_rows: int = BLOCK_ROWS, fan: int = FAN) -> Factor:
    """The QR of the rows ``col``; ``keep`` columns (ids, and columns to
    multiply) stay with their rows. Null rows and rows of another width
    raise; an empty table raises."""
    d = width(df, col)
    ship_package(df.sparkSession)
    fields = [df.schema[c] for c in keep]
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("k", T.IntegerType()),
                           T.StructField("v", T.BinaryType()), T.StructField("t", T.BinaryType()), T.StructField("r", T.BinaryType()),
                           *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields]])
    names = [f.name for f in schema.fields]

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block(parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            x = batch_matrix(table.to_batches()[0], col, d)
            v, t, r = block_qr(x)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), table.column(c).combine_chunks().cast(_arrow_type(f.dataType)))
                     for c, f in zip(keep, fields)]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([len(r)], pa.int32()),
                 *[pa.array([_pack(y)], pa.binary()) for y in (v, t, r)], *lists], names=names)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, block_rows - size)
                at += piece.num_rows
                held.append(piece)
                size += piece.num_rows
                if size == block_rows:
                    yield block(held)
                    number, held, size = number + 1, [], 0
        if held:
            yield block(held)

    whole = stored(df.select(*dict.fromkeys([*keep, col])).mapInArrow(leaves, schema), "qr-leaves")
    most = whole.agg(F.max("a"), F.max("b")).first()
    shape = _shape(most[0], most[1], fan)
    levels, below = [], whole.select("a", "b", "k", "r")

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b"])
        v, t, r = block_qr(np.vstack([_unpack(x, k) for x, k in zip(pdf["r"], pdf["k"])]))
        return pd.DataFrame({"a": [key[0]], "b": [key[1]], "k": [len(r)], "v": [_pack(v)], "t": [_pack(t)], "ca": [pdf["a"].tolist()],
                             "cb": [pdf["b"].tolist()], "ck": [pdf["k"].tolist()], "r": [_pack(r)]})

    for i in range(len(shape)):
        level = below.groupBy(*_parent(shape, i)).applyInPandas(meet, f"{_NODE}, r binary")
        levels.append(stored(level, "qr-level"))
        below = levels[-1].select("a", "b", "k", "r")
    root = below.collect()
    r = np.zeros((d, d))
    r[:root[0]["k"]] = _unpack(bytes(root[0]["r"]), root[0]["k"])
    signs = np.where(np.diag(r) < 0, -1.0, 1.0)
    return Factor(whole, levels, shape, canonical_r(r), signs, tuple(keep))


def _parent(shape: list[tuple[int, int]], i: int) -> list[Column]:
    """Number of the parent on level i, from the numbers (a, b) on the level below."""
    a, b = shape[i - 1] if i else (1, 1)
    return [F.floor(F.col("a") / (shape[i][0] // a)).alias("pa"), F.floor(F.col("b") / (shape[i][1] // b)).alias("pb")]


# ---------------------------------------------------------------- products

class Coordinates(NamedTuple):
    """Q^T x: ``top`` belongs to R's rows, the rest stays where it arose."""
    top: np.ndarray
    leaf: DataFrame | None              # a, b, tail; None for zeros
    levels: list[DataFrame] | None

    def norm_sq(self) -> float:
        """Squared length of all coordinates."""
        total = float(self.top @ self.top)
        for t in [] if self.leaf is None else [self.leaf, *self.levels]:
            total += t.agg(F.sum("sq")).first()[0] or 0.0
        return total

    def drop(self) -> None:
        """Remove the tables of the coordinates."""
        forget(*([] if self.leaf is None else [self.leaf, *self.levels]))


_COORDINATES = "a long, b long, c binary, tail binary, sq double"


def qt(f: Factor, x: str) -> Coordinates:
    """Q^T x for a kept double column. One pass over the leaves, narrow;
    then d numbers a block go up the tree."""
    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b, k, v, t, values = (batch.column(i)[row] for i in range(6))
                z = np.asarray(values.values, dtype=np.float64)
                k = k.as_py()
                z = turn(_unpack(v.as_py(), len(z)), _unpack(t.as_py(), k), z, True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a.as_py()], pa.int64()), pa.array([b.as_py()], pa.int64()), pa.array([_pack(z[:k])], pa.binary()),
                     pa.array([_pack(z[k:])], pa.binary()), pa.array([float(z[k:] @ z[k:])], pa.float64())],
                    names=["a", "b", "c", "tail", "sq"])

    if x not in f.keep:
        raise ValueError(f"{x!r} is not a kept column")
    at_leaf = stored(f.leaves.select("a", "b", "k", "v", "t", F.col(x).cast("array<double>")).mapInArrow(leaf, _COORDINATES), "qt-leaves")
    levels, below = [], at_leaf
    for i, nodes in enumerate(f.levels):
        def up(node: pd.DataFrame, children: pd.DataFrame) -> pd.DataFrame:
            n = node.iloc[0]
            z = np.concatenate([_unpack(c) for c in children.sort_values(["a", "b"])["c"]])
            z = turn(_unpack(n["v"], len(z)), _unpack(n["t"], n["k"]), z, True)
            rest = z[n["k"]:]
            return pd.DataFrame({"a": [n["a"]], "b": [n["b"]], "c": [_pack(z[:n["k"]])], "tail": [_pack(rest)], "sq": [float(rest @ rest)]})

        children = below.select("a", "b", "c").groupBy(*_parent(f.shape, i))
        level = nodes.select("a", "b", "k", "v", "t").groupBy("a", "b").cogroup(children).applyInPandas(up, _COORDINATES)
        levels.append(stored(level, "qt-level"))
        below = levels[-1]
    top = _unpack(bytes(below.select("c").first()["c"]))
    out = np.zeros(len(f.signs))
    out[:len(top)] = top
    return Coordinates(out * f.signs, at_leaf, levels)


def q(f: Factor, x: Coordinates, out: str = "x") -> DataFrame:
    """Q x per row: the kept columns and ``out``. Without tails (``leaf`` is
    None) they count as zeros: x.top times the first d columns of Q. The
    leaves meet d numbers each; Spark broadcasts those while they are few and
    sorts both sides otherwise."""
    spark = f.leaves.sparkSession
    if out in f.keep:
        raise ValueError(f"{out!r} is a kept column")
    start = pd.DataFrame({"a": [0], "b": [0], "c": [_pack(np.asarray(x.top, dtype=float) * f.signs)]})
    above = spark.createDataFrame(start, "a long, b long, c binary")
    for i in reversed(range(len(f.levels))):
        nodes = f.levels[i].select("a", "b", "k", "v", "t", "ca", "cb", "ck").join(above, ["a", "b"])
        nodes = nodes.withColumn("tail", F.lit(None).cast("binary")) if x.leaf is None else \
            nodes.join(x.levels[i].select("a", "b", "tail"), ["a", "b"])

        def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for n in pdf.itertuples(index=False):
                    z = np.zeros(sum(n.ck))
                    z[:n.k] = _unpack(n.c)[:n.k]
                    if n.tail is not None:
                        z[n.k:] = _unpack(n.tail)
                    z = turn(_unpack(n.v, len(z)), _unpack(n.t, n.k), z, False)
                    ends = np.cumsum(n.ck)
                    rows += [(a, b, _pack(z[e - k:e])) for a, b, k, e in zip(n.ca, n.cb, n.ck, ends)]
                yield pd.DataFrame(rows, columns=["a", "b", "c"])

        above = nodes.mapInPandas(down, "a long, b long, c binary")
    schema = T.StructType([*[T.StructField(c, f.leaves.schema[c].dataType.elementType) for c in f.keep], T.StructField(out, T.DoubleType())])
    leaves = f.leaves.drop("r").join(above, ["a", "b"])
    leaves = leaves.withColumn("tail", F.lit(None).cast("binary")) if x.leaf is None else \
        leaves.join(x.leaf.select("a", "b", "tail"), ["a", "b"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                one = {name: batch.column(j)[i] for name, j in at.items()}
                k = one["k"].as_py()
                v, t = one["v"].as_py(), _unpack(one["t"].as_py(), k)
                lists = [one[c].values for c in f_keep]
                n = len(v) // 8 // k
                z = np.zeros(n)
                z[:k] = _unpack(one["c"].as_py())
                if one["tail"].is_valid:
                    z[k:] = _unpack(one["tail"].as_py())
                yield pa.RecordBatch.from_arrays([*lists, pa.array(turn(_unpack(v, n), t, z, False))], names=[*f_keep, out])

    f_keep = f.keep
    return leaves.select("a", "b", "k", "v", "t", "c", "tail", *f.keep).mapInArrow(rows, schema)


def thin_rows(f: Factor, c: np.ndarray, out: str = "x") -> DataFrame:
    """The first columns of Q times ``c``, per row."""
    top = np.zeros(len(f.signs))
    top[:len(c)] = c
    return q(f, Coordinates(top, None, None), out)


# ---------------------------------------------------------------- rank decision

class Pivoted(NamedTuple):
    order: list[int]        # columns, pivots first
    rank: int
    r: np.ndarray           # rank x d, columns in ``order``


def _best_columns(m: np.ndarray, columns: list[int], count: int, near: float) -> list[int]:
    """Up to ``count`` of the columns of ``m`` by greedy pivoting: the longest
    remainder first; of lengths within ``near`` the first column."""
    rest = m[:, columns].astype(float).copy()
    picked: list[int] = []
    for _ in range(min(count, len(columns))):
        norms = (rest * rest).sum(axis=0)
        norms[picked] = -1.0
        if norms.max() <= 0:
            break
        j = int(np.flatnonzero(norms >= (1.0 - near) * norms.max())[0])
        u = rest[:, j] / np.sqrt(norms[j])
        rest -= np.outer(u, u @ rest)
        picked.append(j)
    return [columns[j] for j in picked]


def tournament(m: np.ndarray, columns: list[int], panel: int, near: float = 1e-8) -> list[int]:
    """The ``panel`` pivot columns by a tournament: panels of columns meet in
    pairs up a tree, each match keeps the best ``panel`` of two."""
    field = [_best_columns(m, columns[i:i + panel], panel, near) for i in range(0, len(columns), panel)]
    while len(field) > 1:
        pairs = [field[i:i + 2] for i in range(0, len(field), 2)]
        field = [_best_columns(m, sorted(sum(p, [])), panel, near) if len(p) == 2 else p[0] for p in pairs]
    return field[0] if field else []


def pivoted_r(r: np.ndarray, tol: float = 1e-10, panel: int = 32, zero_tol: float = 0.0) -> Pivoted:
    """Column order, numerical rank and R of A P = Q R from the R factor of A
    (``factor(...).r`` or ``tsqr_r``), so they do not depend on how the rows
    are spread. Columns are chosen by tournaments of panels; the rank counts
    the diagonal entries above ``tol`` times the first; entries of R below
    ``zero_tol`` become zero (off by default). Equal columns: the first one
    is the pivot."""
    r = np.asarray(r, dtype=float)
    order: list[int] = []
    rest, left = r.copy(), list(range(r.shape[1]))
    scale = np.sqrt((r * r).sum(axis=0).max(initial=0.0))
    while left:
        norms = np.sqrt((rest[:, left] ** 2).sum(axis=0))
        if not norms.max() > tol * scale:
            break
        for j in tournament(rest, left, panel):
            u = rest[:, j].copy()
            length = np.linalg.norm(u)
            if not length > tol * scale:
                break
            u /= length
            order.append(j)
            left.remove(j)
            rest[:, left] -= np.outer(u, u @ rest[:, left])
            rest[:, j] = 0.0
    full = order + left
    out = canonical_r(np.linalg.qr(r[:, full], mode="r"))[:len(order)]
    return Pivoted(full, len(order), np.where(np.abs(out) < zero_tol, 0.0, out))

"""The joins that the reference's index loops perform.

Point-to-center work never joins the rows with the centers: K centers are
few (K x d on the driver, bounded in bytes) and travel with the function that
computes a batch's distances as one numpy block - no shuffle, no nested-loop
join. Only genuinely small sides (centers, sampled landmarks) are ever paired
all-against-all.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import linalg as L

# Most bytes of a center / landmark set that travels with a task.
MAX_CENTER_BYTES = 64 << 20


def check_centers(centers) -> np.ndarray:
    c = np.asarray(centers, dtype=float)
    if c.nbytes > MAX_CENTER_BYTES:
        raise ValueError(f"{c.shape[0]} centers of width {c.shape[1]}: over {MAX_CENTER_BYTES} bytes")
    return c


def block_distances(X: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """(n, K) squared distances by explicit differences, a center at a time."""
    out = np.empty((len(X), len(centers)))
    for k, c in enumerate(centers):
        diff = X - c
        out[:, k] = np.einsum("ij,ij->i", diff, diff)
    return out


def positional_zip(rows: DataFrame, labels: DataFrame, key: str = "row_id",
                   check_counts: bool = True) -> DataFrame:
    """Align two row sets by position (C1): both carry a 0-based ``key``
    (see ``with_row_id``). One full outer join, which raises on a position
    that only one side has when it runs, so nothing is counted beforehand;
    without ``check_counts`` such positions are left out."""
    if not check_counts:
        return rows.join(labels, key, "inner")
    both = rows.withColumn("_ks_l", F.lit(True)).join(labels.withColumn("_ks_r", F.lit(True)), key, "full_outer")
    alone = F.raise_error(F.concat(F.lit("positional zip: only one side has position "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    paired = F.when(F.col("_ks_l").isNull() | F.col("_ks_r").isNull(), alone.cast("boolean")).otherwise(F.lit(True))
    return both.filter(paired).drop("_ks_l", "_ks_r")


def center_distances(df: DataFrame, centers: Sequence[Sequence[float]],
                     features: str = "features", out: str = "dists") -> DataFrame:
    """Squared distance of each row to each of K centers (C2), as an
    ``array<double>`` of K entries."""
    c = check_centers(centers)
    ship_package(df.sparkSession)

    @F.arrow_udf("array<double>")
    def distances(x: pa.Array) -> pa.Array:
        return L.matrix_to_list_array(block_distances(L.list_matrix(x, c.shape[1]), c))

    return df.withColumn(out, distances(F.col(features)))


def collect_small(df: DataFrame, key: str, features: str = "features",
                  limit: int = 4096) -> tuple[list, np.ndarray]:
    """Keys and vectors of a small row set, checked to be at most ``limit``
    rows before anything is collected."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows: not a small side")
    rows = df.select(key, features).orderBy(key).collect()
    return [r[0] for r in rows], np.asarray([list(r[1]) for r in rows], dtype=float)


def pairwise(left: DataFrame, right: DataFrame, lkey: str, rkey: str,
             features: str = "features", gamma: float | None = None) -> DataFrame:
    """Each left row against each row of a small right set: squared distance
    (C4) or RBF kernel value (C3, when ``gamma`` is given), as
    ``(i, j, value)``.

    The right side (centers, landmarks, centroids) is size-checked, so the
    work is one narrow map of the left rows plus an explode - linear in the
    left rows, no join.
    """
    keys, pts = collect_small(right, rkey, features)
    value = F.col("d") if gamma is None else F.transform("d", lambda v: F.exp(v * F.lit(-gamma)))
    near = center_distances(left.select(F.col(lkey).alias("i"), F.col(features).alias("x")), pts, "x", "d")
    pairs = F.arrays_zip(F.array(*[F.lit(k) for k in keys]).alias("j"), value.alias("value"))
    return (near.select("i", F.explode(pairs).alias("p"))
                .select("i", F.col("p.j").alias("j"), F.col("p.value").alias("value")))


def cluster_pairs(kernel: DataFrame, threshold: float) -> DataFrame:
    """Pairs i < j of a K x K kernel table ``(i, j, value)`` whose value is at
    least the threshold (C5)."""
    return kernel.filter((F.col("i") < F.col("j")) & (F.col("value") >= F.lit(threshold)))


def _pack_rows(keys: np.ndarray, X: np.ndarray) -> tuple[bytes, bytes]:
    """Keys and vectors as bytes: vectors that are whole 32-bit numbers travel
    as such, by byte planes, compressed."""
    narrow = X.astype(np.float32)
    X = narrow if np.array_equal(narrow, X) else X
    planes = X.reshape(-1).view(np.uint8).reshape(-1, X.itemsize).T.tobytes()
    return keys.tobytes(), bytes([X.itemsize]) + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def _unpack_rows(keys: bytes, x: bytes, d: int) -> tuple[np.ndarray, np.ndarray]:
    k, size = np.frombuffer(keys, np.int64), x[0]
    planes = pa.Codec("zstd").decompress(x[1:], decompressed_size=len(k) * d * size, asbytes=True)
    X = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(np.float32 if size == 4 else np.float64)
    return k, X.reshape(len(k), d).astype(np.float64)


#: Copies of a right row, unless its cells need more parts to be held: a part's left rows take at most so many bytes.
LINK_COPIES, LINK_HELD_BYTES = 8, 64 << 20
#: Left and right rows whose distances are one block.
LINK_TILE = 1024, 512


def link_parts(sizes: Sequence[int], block_rows: int, width: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Cells of ``sizes`` rows, laid end to end, cut into parts of as many
    rows: ``block_rows``, or more where there would be over ``LINK_COPIES``
    parts, but no more than ``LINK_HELD_BYTES``. Gives where each cell begins
    and ends, the rows of a part and the number of parts."""
    most = max(1, LINK_HELD_BYTES // (8 * max(1, width)))
    ends = np.cumsum(np.asarray(sizes, np.int64))
    room = min(most, max(block_rows, -(-int(ends[-1]) // LINK_COPIES)))
    return ends - sizes, ends, room, -(-int(ends[-1]) // room)


def _linked(A: np.ndarray, Y: np.ndarray, sq: float) -> np.ndarray:
    """Whether the squared distances of two blocks are at most ``sq``: by one
    matrix product, and by differences where its rounding could decide."""
    a2, y2 = np.einsum("ij,ij->i", A, A), np.einsum("ij,ij->i", Y, Y)
    err = 8 * (A.shape[1] + 8) * np.finfo(float).eps * (a2.max() + y2.max() + sq)
    if not np.isfinite(err):
        return block_distances(A, Y) <= sq
    one = np.ones
    d = np.hstack([-2 * A, a2[:, None], one((len(A), 1))]) @ np.hstack([Y, one((len(Y), 1)), y2[:, None]]).T
    hit = d <= sq + err
    near = np.flatnonzero(hit & (d >= sq - err))
    for k in range(0, len(near), 1 << 14):
        i, j = np.divmod(near[k:k + (1 << 14)], len(Y))
        diff = A[i] - Y[j]
        hit[i, j] = np.einsum("ij,ij->i", diff, diff) <= sq
    return hit


def kernel_links(left: DataFrame, right: DataFrame, lkey: str, rkey: str, gamma: float, threshold: float,
                 features: str = "features", pivots: int = 64, seed: int = 42, block_rows: int = 2048,
                 same_rows: bool = False) -> DataFrame:
    """For each left row, how many right rows have a kernel value of at least
    ``threshold`` (C3 + C5 between two large sides): (i, n_links, first_link
    (the least linked key, else null)). Keys are whole numbers.

    The kernel is a distance r, so rows meet by metric partitioning: a left
    row belongs to the cell of its nearest pivot; a right row meets the cells
    that a row within r of it can lie in, by the triangle inequality (its
    distance to the pivot is at most its least one plus 2 r, and at most the
    cell's radius plus r). The cells, in which a hash of the key orders the
    rows, are cut into parts (``link_parts``) of ``block_rows`` left rows, or
    of more: each part gets a copy of the right rows that meet its cells, and
    there are at most ``LINK_COPIES`` as long as a task can hold a part. Rows
    travel in packed blocks; a task holds one part's left rows and streams
    the right ones past them, so neither pairs nor a side are held or
    emitted. The first ``pivots`` left rows of the seeded order are the
    pivots; any choice gives the same rows.

    ``same_rows``: both sides are one table, a row is no link of itself. Null
    or empty vectors raise; a null key raises. Empty sides: no rows, or no
    links.
    """
    from . import cluster as CL
    from . import sampling as S
    if not 0 < threshold <= 1:
        raise ValueError(f"threshold {threshold} outside (0, 1]")
    spark = left.sparkSession
    ship_package(spark)
    r = float(np.sqrt(-np.log(threshold) / gamma))
    left = left.select(F.col(lkey).cast("long").alias("i"), F.col(features).alias("x"))
    right = right.select(F.col(rkey).cast("long").alias("j"), F.col(features).alias("x"))
    first = left.select(S.perm_key(seed, ["i"]).alias("k"), "i", "x").orderBy("k", "i").limit(pivots).collect()
    empty = "i long, n_links long, first_link long"
    if not first:
        return spark.createDataFrame([], empty)
    P = check_centers([list(p["x"]) for p in first])
    placed = CL.assign_clusters(left, P, "x", "cell")
    cells = {c["cell"]: c for c in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max("sq_dist")).alias("radius")).collect()}
    start, end, room, parts = link_parts([cells[c]["n"] if c in cells else 0 for c in range(len(P))], block_rows, P.shape[1])
    radius = np.array([cells[c]["radius"] if c in cells else -np.inf for c in range(len(P))])
    slack = 1e-9 * (1.0 + r + float(np.abs(P).max()))

    def reached(X: np.ndarray) -> np.ndarray:
        """The cells that a row within r of these rows can lie in."""
        d = np.sqrt(block_distances(X, P))
        return (d <= d.min(axis=1, initial=np.inf)[:, None] + 2 * r + slack) & (d <= radius + r + slack)

    def vectors(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        if b.column(0).null_count:
            raise ValueError("null key")
        return b.column(0).to_numpy(), L.list_matrix(b.column(1), P.shape[1])

    def packed(rows):
        cols = list(zip(*rows)) if rows else [()] * 5
        types = pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["part", "side", "cells", "keys", "x"])

    def place_left(batches):
        for b in batches:
            keys, X = vectors(b)
            cell = b.column(2).to_numpy()
            part = (start[cell] + b.column(3).to_numpy() % (end - start)[cell]) // room
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                yield packed([(p, 0, cell[at].astype(np.int32).tobytes(), *_pack_rows(keys[at], X[at]))])

    def place_right(batches):
        for b in batches:
            keys, X = vectors(b)
            near = reached(X)
            goes = np.zeros((len(keys), parts), bool)
            for c in np.flatnonzero(end > start):
                goes[:, start[c] // room:(end[c] - 1) // room + 1] |= near[:, c:c + 1]
            for p in np.flatnonzero(goes.any(axis=0)):
                yield packed([(p, 1, None, *_pack_rows(keys[goes[:, p]], X[goes[:, p]]))])

    none = np.iinfo(np.int64).max

    def meet(A, mine, n, least, X, other):
        """Links of one cell's left rows with right rows in the order of their keys."""
        for lo in range(0, len(A), LINK_TILE[0]):
            t = slice(lo, min(lo + LINK_TILE[0], len(A)))
            for k in range(0, len(X), LINK_TILE[1]):
                there = other[k:k + LINK_TILE[1]]
                hit = _linked(A[t], X[k:k + LINK_TILE[1]], r * r)
                if same_rows:
                    a, b = np.searchsorted(there, mine[t]), np.searchsorted(there, mine[t], side="right")
                    for row in np.flatnonzero(a < b):
                        hit[row, a[row]:b[row]] = False
                count = np.count_nonzero(hit, axis=1)
                n[t] += count
                least[t] = np.minimum(least[t], np.where(count > 0, there[hit.argmax(axis=1)], none))

    def links(batches):
        held, cell, keys, A, n, least = [], None, None, None, None, None
        for b in batches:
            for row in range(b.num_rows):
                k, X = _unpack_rows(b.column(3)[row].as_py(), b.column(4)[row].as_py(), P.shape[1])
                if not b.column(1)[row].as_py():
                    held.append((np.frombuffer(b.column(2)[row].as_py(), np.int32), k, X))
                    continue
                if not held and cell is None:       # a part whose hash left it no left row has only copies
                    break
                if cell is None:
                    cell, keys, A = _by_cell(held)
                    held, n, least = [], np.zeros(len(keys), np.int64), np.full(len(keys), none)
                order = np.argsort(k, kind="stable")
                k, X = k[order], X[order]
                near = reached(X)
                cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
                for lo, hi in zip(cuts, cuts[1:]):
                    if (to := near[:, cell[lo]]).any():
                        meet(A[lo:hi], keys[lo:hi], n[lo:hi], least[lo:hi], X[to], k[to])
        if held:
            cell, keys, A = _by_cell(held)
            n, least = np.zeros(len(keys), np.int64), np.full(len(keys), none)
        if keys is not None:
            for lo in range(0, len(keys), 1 << 16):
                c, to = n[lo:lo + (1 << 16)], least[lo:lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo:lo + (1 << 16)]), pa.array(c), pa.array(to, mask=c == 0)],
                                                 names=["i", "n_links", "first_link"])

    row = "part int, side int, cells binary, keys binary, x binary"
    mine = placed.select("i", "x", "cell", F.shiftrightunsigned(F.xxhash64("i"), 1).alias("h")).mapInArrow(place_left, row)
    both = mine.unionByName(right.mapInArrow(place_right, row))
    return both.repartitionById(parts, F.col("part")).sortWithinPartitions("side").mapInArrow(links, empty)


def _by_cell(held: list) -> tuple[np.ndarray, ...]:
    """Blocks of (cell, key, vector) as one, in the order of the cells."""
    cell, keys, X = (np.concatenate(z) for z in zip(*held))
    order = np.argsort(cell, kind="stable")
    return cell[order], keys[order], X[order]

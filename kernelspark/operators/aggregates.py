"""Aggregates (E1-E7) and the summation helpers every operator uses.

Global sums are always Spark aggregates: a partial aggregate per task, then
a merge. When the input has many partitions the merge is split in two levels
(a group per partition bucket first) so that no single task receives one
partial row from every one of, say, 100k map tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import forget, ship_package, stored

# Buckets of the first level of a global merge, and blocks that meet at once.
TREE_FAN = 64
# Blocks of up to so many numbers are added cell by cell.
FLAT_CELLS = 1 << 14


def tree_agg(df: DataFrame, named_sums: dict[str, Column], fan: int = TREE_FAN) -> DataFrame:
    """One-row DataFrame of ``sum(expr) AS name`` for each entry.

    ``named_sums`` maps output names to per-row expressions (Columns or SQL
    text). Rows are summed per bucket of input partitions
    (``spark_partition_id() % fan``) and the ``fan`` buckets once more, at
    every size, so the partition count is never asked for: under adaptive
    execution that would run the stages below.
    """
    cols = {n: (F.expr(e) if isinstance(e, str) else e) for n, e in named_sums.items()}
    level1 = df.groupBy((F.spark_partition_id() % F.lit(fan)).alias("_ks_bucket")).agg(
        *[F.sum(e).alias(n) for n, e in cols.items()])
    return level1.agg(*[F.sum(F.col(n)).alias(n) for n in named_sums])


def collect_sums(df: DataFrame, named_sums: dict[str, Column], fan: int = TREE_FAN) -> dict[str, float]:
    """Driver values of ``tree_agg`` (a bounded number of scalars)."""
    row = tree_agg(df, named_sums, fan).first()
    return {k: (0.0 if row[k] is None else float(row[k])) for k in named_sums}


def block_partials(df: DataFrame, length: int, add) -> DataFrame:
    """One row ``(p int, v array<double>)`` per task: a numpy block of
    ``length`` sums to which ``add(block, batch)`` adds each Arrow batch."""
    def fn(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        block = np.zeros(length)
        for b in batches:
            if b.num_rows:
                add(block, b)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()),
             pa.array([block], pa.list_(pa.float64()))], names=["p", "v"])

    ship_package(df.sparkSession)
    return df.mapInArrow(fn, "p int, v array<double>")


def tree_levels(partials: DataFrame, number: str, schema: str, meet, fan: int = TREE_FAN) -> DataFrame:
    """Rows numbered from 0 meet ``fan`` at a time, level by level, until at
    most ``fan`` are left: ``meet(pdf)`` makes one row (without its number)
    of a sorted group. No task sees more than ``fan`` rows at once, whatever
    their number; each level is written to the shared folder."""
    import pandas as pd
    level, tables = stored(partials, "tree"), []
    top = level.agg(F.max(number)).first()[0]

    def group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = meet(pdf.sort_values(number))
        out.insert(0, number, [key[0]])
        return out

    while top is not None and top >= fan:
        tables.append(level)
        level = stored(level.groupBy(F.floor(F.col(number) / fan).alias("_ks_up")).applyInPandas(group, schema), "tree")
        top //= fan
    forget(*tables)
    return level


def collect_block_sum(partials: DataFrame, length: int, fan: int = TREE_FAN) -> np.ndarray:
    """The sum of all blocks ``(p, v)`` on the driver. Blocks of up to
    ``FLAT_CELLS`` numbers are added cell by cell in the JVM; wider ones meet
    as whole blocks, ``fan`` at a time."""
    out = np.zeros(length)
    if length <= FLAT_CELLS:
        for r in sum_arrays(partials, "v", length).collect():
            out[r["pos"]] = r["value"]
        return out

    def meet(pdf):
        import pandas as pd
        total = np.zeros(length)
        for v in pdf["v"]:
            total += v
        return pd.DataFrame({"v": [total]})

    last = tree_levels(partials, "p", "p int, v array<double>", meet, fan)
    for r in last.orderBy("p").toLocalIterator():
        out += np.asarray(r["v"], dtype=float)
    forget(last)
    return out


def sum_arrays(df: DataFrame, col: str, length: int) -> DataFrame:
    """Element-wise sum of equal-length ``array<double>`` rows.

    posexplode + groupBy(pos): the merge is spread over the shuffle
    partitions by position, so no task holds more than its share of cells.
    Returns ``(pos int, value double)``; positions with no rows are absent.
    """
    return (df.select(F.posexplode(F.col(col)).alias("pos", "value"))
              .groupBy("pos").agg(F.sum("value").alias("value")))


def matrix_sum(cells: DataFrame) -> DataFrame:
    """Sum of matrices given as ``(i, j, value)`` cells."""
    return cells.groupBy("i", "j").agg(F.sum("value").alias("value"))


def partition_counts(df: DataFrame) -> DataFrame:
    """Rows per physical partition (E1) - a diagnostic, nothing depends on it."""
    return (df.groupBy(F.spark_partition_id().alias("partition"))
              .agg(F.count(F.lit(1)).alias("n")))


def cluster_sizes(df: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """Rows per cluster."""
    return df.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, prediction: str = "prediction", label: str = "label",
              positive: float = 1.0, negative: float = -1.0) -> DataFrame:
    """Confusion counts and accuracy in percent (E3, E4) in one aggregate.

    wrong_pos: predicted positive, label not +1; wrong_neg: predicted
    negative, label not -1 (labels outside {+1, -1} always count as wrong).
    """
    pos = F.col(prediction) > F.lit(0.0)
    lab = F.col(label)
    cp = pos & (lab == F.lit(positive))
    cn = ~pos & (lab == F.lit(negative))
    wp = pos & ~(lab == F.lit(positive))
    wn = ~pos & ~(lab == F.lit(negative))
    agg = df.agg(
        F.count_if(cp).alias("correct_pos"), F.count_if(cn).alias("correct_neg"),
        F.count_if(wp).alias("wrong_pos"), F.count_if(wn).alias("wrong_neg"),
        F.count(F.lit(1)).alias("n"))
    return agg.select(
        (F.col("correct_pos") + F.col("correct_neg")).alias("correct"),
        (F.col("wrong_pos") + F.col("wrong_neg")).alias("wrong"),
        "correct_pos", "correct_neg", "wrong_pos", "wrong_neg",
        (F.lit(100.0) * (F.col("correct_pos") + F.col("correct_neg"))
         / F.col("n")).alias("accuracy"))


def argmin_cluster(df: DataFrame, dist_col: str = "dists", out: str = "cluster") -> DataFrame:
    """Index of the smallest distance, ties to the lowest index (E5)."""
    return df.withColumn(out, V.argmin(dist_col))


def bias_from_support(df: DataFrame, features: str = "features", label: str = "label",
                      alpha: str = "alpha", threshold: float = 0.001,
                      order_col: str = "row_id") -> DataFrame:
    """b = y_k - sum_i alpha_i y_i (x_i . x_k), k = first support vector.

    Support vectors are rows with alpha above ``threshold``; "first" is the
    smallest ``order_col``. Only the single row x_k (d values) reaches the
    driver; the sum is one aggregate with x_k as a literal.
    """
    sv = df.filter(F.col(alpha) > F.lit(threshold))
    first = sv.agg(F.min_by(F.struct(F.col(features).alias("xk"), F.col(label).alias("yk")),
                            F.col(order_col)).alias("k")).first()["k"]
    if first is None:
        raise ValueError("no support vector above the threshold")
    xk, yk = list(first["xk"]), float(first["yk"])
    return sv.agg(
        (F.lit(yk) - F.sum(F.col(alpha) * F.col(label) * V.dot_const(features, xk))
         ).alias("bias"),
        F.count(F.lit(1)).alias("n_support"))


def rank_offsets(df: DataFrame, order_col: str = "cluster", rank_col: str = "rank",
                 out: str = "col_offset") -> DataFrame:
    """Exclusive running sum of ``rank_col`` in ``order_col`` order (F1).

    Used on per-cluster tables (K rows), so the single-partition window is
    bounded by the cluster count.
    """
    w = Window.orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(rank_col).over(w), F.lit(0)).cast("int"))

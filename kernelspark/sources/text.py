"""Text sources of dense numeric rows and labels.

Lines are read with ``spark.read.text``; a line's position (the reference
aligns rows and labels by line number) comes from the file metadata: file
path, start of the file split, and the order within the split. All parsing
is column expressions: ``trim`` / ``split`` / ``cast``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import global_rank


def read_lines(spark: SparkSession, path: str, with_position: bool = True) -> DataFrame:
    """``value`` per line, plus ``row_id`` = 0-based line number over the
    files in path order when ``with_position``."""
    df = spark.read.text(path)
    if not with_position:
        return df
    df = df.select("value", F.col("_metadata.file_path").alias("_ks_file"),
                   F.col("_metadata.file_block_start").alias("_ks_start"),
                   F.monotonically_increasing_id().alias("_ks_mid"))
    return global_rank(df, ["_ks_file", "_ks_start", "_ks_mid"], "row_id").select(
        "row_id", "value")


def _tokens(sep: str, trim: bool = True):
    v = F.trim(F.col("value")) if trim else F.col("value")
    return F.split(v, sep)


def parse_dense(lines: DataFrame, n_cols: int | None, sep: str = " ", strict: bool = True,
                trim: bool = True, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """``features array<double>`` from the first ``n_cols`` tokens.

    strict: every line must have exactly ``n_cols`` tokens (A2's width
    check, raised by ``raise_error`` inside the plan); otherwise extra tokens
    are ignored and short lines fail on the missing token.
    """
    toks = _tokens(sep, trim)
    if n_cols is None:
        feats = F.transform(toks, lambda t: t.cast("double"))
        return lines.select(*keep, feats.alias("features"))
    vals = F.transform(F.slice(toks, 1, n_cols), lambda t: t.cast("double"))
    if strict:
        ok = F.size(toks) == F.lit(n_cols)
    else:
        ok = F.size(toks) >= F.lit(n_cols)
    checked = F.when(ok, vals).otherwise(
        F.raise_error(F.concat(F.lit("line has wrong width: "), F.col("value"))))
    return lines.select(*keep, checked.alias("features"))


def labeled_rows(lines: DataFrame, n_cols: int, sep: str = " ") -> DataFrame:
    """A1 on lines ``(row_id, value)``: the first n_cols values; the last of
    them is the label."""
    dense = parse_dense(lines, n_cols, sep, strict=False)
    return dense.select("row_id", F.slice("features", 1, n_cols - 1).alias("features"),
                        F.element_at("features", n_cols).alias("label"))


def dense_rows(lines: DataFrame, n_cols: int, sep: str = " ",
               strict: bool = True, append_bias: bool = False) -> DataFrame:
    """A2 (strict width) / A4 (hold-out: ``sep=','``, first n_cols values,
    then a constant 1.0 appended with ``append_bias``) on lines."""
    dense = parse_dense(lines, n_cols, sep, strict=strict)
    if append_bias:
        dense = dense.withColumn("features", F.concat("features", F.array(F.lit(1.0))))
    return dense


def first_labels(lines: DataFrame, sep: str = " ") -> DataFrame:
    """A3 on lines: the first token of each as a double label."""
    return lines.select("row_id", _tokens(sep)[0].cast("double").alias("label"))


def read_labeled_rows(spark: SparkSession, path: str, n_cols: int, sep: str = " ") -> DataFrame:
    return labeled_rows(read_lines(spark, path), n_cols, sep)


def read_dense_rows(spark: SparkSession, path: str, n_cols: int, sep: str = " ",
                    strict: bool = True, append_bias: bool = False) -> DataFrame:
    return dense_rows(read_lines(spark, path), n_cols, sep, strict, append_bias)


def read_labels(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    return first_labels(read_lines(spark, path), sep)


def check_count(df: DataFrame, expected: int, what: str = "rows") -> int:
    """A5: raise if a source has more or fewer rows than declared."""
    n = df.count()
    if n != expected:
        raise ValueError(f"{what}: {n} found, {expected} declared")
    return n


def head_rows(df: DataFrame, n: int, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """The first n rows in order (a top-n, planned as TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def with_row_id(df: DataFrame, order_cols: Sequence[str], out: str = "row_id") -> DataFrame:
    """A stable 0-based position in the order of ``order_cols``."""
    return global_rank(df, list(order_cols), out)


def rows_from_matrix(spark: SparkSession, matrix, labels=None) -> DataFrame:
    """A small in-memory matrix (list of rows) as row DataFrame."""
    rows = [(i, [float(v) for v in r], None if labels is None else float(labels[i]))
            for i, r in enumerate(matrix)]
    return spark.createDataFrame(rows, "row_id bigint, features array<double>, label double")


def write_history(history: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The convergence series (iteration, error) as a table."""
    history.write.mode("overwrite").format(fmt).save(path)

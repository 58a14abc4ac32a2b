"""Helpers that several of the operators share: the token pattern, tables in
the shared folder, distributed running totals."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kernelspark.session import checkpoint_dir

#: A word: a run without ASCII white space (the class that bytes.split() cuts at).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of words, JVM side."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def md5_uniform(*parts: Column) -> tuple[Column, Column]:
    """A hash key (md5, hex) of the parts and the number in [0, 1) that its
    first 52 bits give; the number grows with the key. Null parts hash as
    the word 'null'."""
    key = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return key, F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


def shared_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it
    back: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=partition_by)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop_shared(df: DataFrame) -> None:
    """Delete a table of ``shared_table`` that nothing reads any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        spark: SparkSession = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def running_total(df: DataFrame, groups: list[str], uniform: str, order: list[str], value: Column,
                  out: str, rows: int, per_bucket: int = 50_000) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in its
    group, in the order (``uniform``, ``order``).

    ``uniform`` is hash-random in [0, 1), so ``floor(uniform * buckets)`` cuts
    every group into ranges of at most about ``per_bucket`` rows, however hot
    the group. Ranges are summed, the sums run over the ranges of each group,
    and each row adds its place inside its range. ``rows`` is the row count;
    ``groups`` must hold no nulls.
    """
    buckets = max(1, math.ceil(rows / per_bucket))
    at = df.withColumn("_b", F.floor(F.col(uniform) * F.lit(buckets)).cast("int")).withColumn("_v", value)
    keys = [*groups, "_b"]
    sums = at.groupBy(*keys).agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*keys).orderBy(uniform, *order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = at.withColumn("_i", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return (ranked.join(offsets, keys).withColumn(out, (F.col("_i") + F.col("_o")).cast("long"))
            .drop("_b", "_v", "_i", "_o"))

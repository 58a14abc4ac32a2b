"""Row-wise projections and filters on labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def add_bias(df: DataFrame, features: str = "features") -> DataFrame:
    """(x, 1): append the bias entry (B1)."""
    return df.withColumn(features, V.with_bias(features))


def sign_rows(df: DataFrame, features: str = "features", label: str = "label",
              out: str = "features") -> DataFrame:
    """a = y * x for every entry (B2)."""
    return df.withColumn(out, V.scale(features, F.col(label)))


def scale_rows(df: DataFrame, weights: DataFrame, features: str = "features",
               weight: str = "weight", key: str = "row_id") -> DataFrame:
    """Each row times its own scalar from ``weights``.

    Every row must find exactly one non-null weight: one left join, and the
    plan raises on a missing, null or repeated weight, so no row is dropped
    or repeated. Weights without a row are ignored.
    """
    one = weights.groupBy(key).agg(F.first(weight).alias("_ks_w"), F.count(F.lit(1)).alias("_ks_n"))
    joined = df.join(one, key, "left")
    checked = F.when((F.col("_ks_n") == 1) & F.col("_ks_w").isNotNull(), F.col("_ks_w")).otherwise(
        F.raise_error(F.concat_ws(" ", F.coalesce(F.col("_ks_n"), F.lit(0)).cast("string"),
                                  F.lit("weights for row"), F.col(key).cast("string"))).cast("double"))
    return joined.withColumn(features, V.scale(features, checked)).drop("_ks_w", "_ks_n")


def elementwise(df: DataFrame, features: str = "features", op: str = "exp",
                p: float = 1.0, tol: float = 1e-4, out: str | None = None) -> DataFrame:
    """B4-B7 on a vector column: exp, power of non-zeros, clip at 0, zero small."""
    fn = {"exp": lambda c: V.elementwise_exp(c),
          "power": lambda c: V.elementwise_power(c, p),
          "clip_negative": lambda c: V.clip_negative(c),
          "zero_small": lambda c: V.zero_small(c, tol)}[op]
    return df.withColumn(out or features, fn(features))


def support_vectors(df: DataFrame, alpha: str = "alpha", threshold: float = 0.001) -> DataFrame:
    """Rows whose dual value is above the threshold."""
    return df.filter(F.col(alpha) > F.lit(threshold))


def gather(df: DataFrame, ids: DataFrame, key: str = "row_id", pos: str = "pos") -> DataFrame:
    """Rows by a list of ids ``(pos, key)``, in list order.

    An equi-join; Spark broadcasts the id list when its measured size is
    under the broadcast threshold, else it shuffles both sides.
    """
    return ids.select(pos, key).join(df, key, "inner").orderBy(pos)


def gather_ids(elements: DataFrame, index: DataFrame, group: str = "cluster",
               pos: str = "pos", key: str = "row_id") -> DataFrame:
    """Index composition (B10): position in a group -> global id.

    ``elements`` holds (group, key); a member's position is its rank by key
    within the group. ``index`` holds (group, pos) pairs to resolve.
    """
    from .sampling import global_rank
    ranked = global_rank(elements.select(group, key), [group, key], "_ks_g")
    first = ranked.groupBy(group).agg(F.min("_ks_g").alias("_ks_first"))
    positioned = (ranked.join(first, group)
                  .select(group, key, (F.col("_ks_g") - F.col("_ks_first")).alias(pos)))
    return index.join(positioned, [group, pos], "inner")


def slice_features(df: DataFrame, start: int, stop: int, features: str = "features",
                   out: str | None = None) -> DataFrame:
    """Columns [start, stop) of the vector."""
    return df.withColumn(out or features, V.slice0(features, start, stop))

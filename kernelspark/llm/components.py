"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_shared, shared_table


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge and is not its root; the
    root is the smallest node of the component.

    Each round does a large-star and a small-star step: grouped minima and
    joins on the nodes, duplicate edges dropped at once, the edge list
    written to the shared folder. Edges never multiply, and the rounds are
    few (logarithmic in practice). Self loops and repeated edges are
    ignored; an empty list gives an empty result.
    """
    def signature(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()

    e = shared_table(edges.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc")
    seen = signature(e)
    while seen[0]:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        after = shared_table(small, "cc")
        drop_shared(e)
        e, now = after, signature(after)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))

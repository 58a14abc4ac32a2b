"""Mixing sources to target weights by distributed prefix sums.

Each document gets a hash-random key. Inside its source the documents are
range-sorted by that key, running sums of the token counts come from range
totals (``running_total``), and the mix is cut where the running sum reaches
the source's budget, after whole epochs where the budget exceeds the source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, md5_uniform, running_total, shared_table, text_or_empty, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: source, s (its number), source_size, weight, target.

    Sources in code point order, null last, take the weights in turn and
    share the sum of all sizes; a target above ``max_epochs`` times its
    source's size is cut there and the excess reshared by weight among the
    rest. In the order of cap / weight the capped sources are a prefix, and
    the level of the others follows from running sums: one row per source,
    no loop.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    first = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(int(x)) for x in weights])
    numbered = (totals.withColumn("s", F.row_number().over(first))
                .withColumn("weight", F.element_at(w, (F.col("s") - 1) % len(weights) + 1))
                .withColumn("cap", F.col("source_size") * F.lit(max_epochs)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    levels = (numbered
              .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
              .withColumn("w_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
              .withColumn("all_size", F.sum("source_size").over(every))
              .withColumn("all_w", F.sum("weight").over(every))
              .withColumn("level", (F.col("all_size") - F.col("cap_before")).cast("double")
                          / (F.col("all_w") - F.col("w_before")))
              # the first source in this order whose cap lies above the level ends the capped prefix
              .withColumn("open", F.when(F.col("cap") / F.col("weight") > F.col("level"),
                                         F.struct((F.col("cap") / F.col("weight")).alias("r"), "s", "level")))
              .withColumn("level", F.min("open").over(every)["level"]))
    return levels.select("source", "s", "source_size", "weight", F.coalesce(F.least(
        F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
        seed: str = "mix", weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken,
    copies.

    ``taken`` is the exact cut: the document's words in the mix, where the
    last document of a source is cut inside; a source's taken words sum to
    floor(target). ``copies`` is the cut at document borders: how often the
    whole document is used, the document that holds the cut included. Null
    and empty texts have size 0; a null source is a source of its own, the
    last. Rows that repeat an id follow each other in the order of their
    size. A target of 0 (all texts empty) takes nothing. Empty table: empty
    result.
    """
    key, u = md5_uniform(F.lit(seed), F.col(doc_id))
    sizes = shared_table(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), key.alias("key"), u.alias("u"),
        word_count(text_or_empty(text)).alias("size")), "mix-sizes")
    targets = shared_table(source_targets(sizes, weights, max_epochs), "mix-targets")
    numbered = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).select(
        "doc_id", "key", "u", "size", "s", "source_size", "target")
    at = running_total(numbered, ["s"], "u", ["key", "size"], F.col("size"), "at", sizes.count())
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - F.col("epochs") * F.col("source_size")
    cut = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("at")))
    return at.withColumn("epochs", epochs).withColumn("rest", rest).select(
        "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + cut).alias("taken"),
        (F.col("epochs") + F.when(F.col("at") < F.col("rest"), 1).otherwise(0)).alias("copies"))


def mixed_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
                    seed: str = "mix") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``copies``
    says (0 to ``MAX_EPOCHS``), all columns unchanged, texts whole, however
    long. Columns may have any names; edge rows as in ``mix``."""
    plan = mix(docs, text, doc_id, source, seed).filter("copies > 0")
    key, times, copy = (free_name(docs, c) for c in ("mix_id", "mix_times", "mix_copy"))
    # rows that repeat an id cannot be told apart: they share the id's largest number
    copies = plan.groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").cast("int").alias(times))
    joined = docs.join(copies, F.col(doc_id).eqNullSafe(F.col(key)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(key, times, copy)

"""Exact dedup by content sort, in DataFrame operations only.

Normalised texts (ASCII white space deleted) are range-partitioned by sampled
splitters, sorted externally inside each range, and neighbours are compared in
full by the sort-based aggregate that closes a group at the first differing
row. The splitter key is a bounded head of the text, a digest and a salt, so
the driver never samples whole texts, and a text that a third of the rows
share is cut over many ranges. What one (text, salt) run leaves is one row;
those rows meet per SHA-256 and give each group its surviving document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, free_name, text_or_empty


def normalised(text: str = "text") -> Column:
    """The text without ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), SPACE, "")


def _best(length: Column, doc_id: Column) -> Column:
    """Sorts the survivor first: longest original, then smallest id, null ids last."""
    return F.struct((-length).alias("l"), doc_id.isNull().alias("u"), doc_id.alias("id"))


def content_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                   salts: int = 1024, head: int = 32) -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id,
    group_size."""
    rows = docs.select(F.col(doc_id).alias("id"), F.length(text_or_empty(text)).alias("len"),
                       normalised(text).alias("norm"))
    keyed = rows.select(
        "id", "len", "norm", F.substring("norm", 1, head).alias("head"),
        F.xxhash64("norm").alias("digest"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    runs = (keyed.repartitionByRange("head", "digest", "salt")
            .groupBy("head", "digest", "salt", "norm", "text_sha256")
            .agg(F.min(_best(F.col("len"), F.col("id"))).alias("best"), F.count(F.lit(1)).alias("n")))
    return (runs.groupBy("text_sha256").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
            .select("text_sha256", F.col("best.id").alias("keep_id"), "group_size"))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                salts: int = 1024) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and all empty texts are one group. Of equal
    texts the row with the most code points in the original stays, then the
    smallest id; a null id stays only where its group has no other. Very
    long texts are compared whole. Columns other than id and text are left
    aside. Identical
    repeats of a row (same id, same text) share one verdict. Other columns
    are not read. An empty table gives an empty result.
    """
    groups = content_groups(docs, text, doc_id, salts)
    ids = docs.select(F.col(doc_id).alias("doc_id"),
                      F.sha2(normalised(text).cast("binary"), 256).alias("text_sha256"))
    return ids.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged. Rows are told
    apart by id and text, so rows that repeat an id or have none are judged
    each by its own text."""
    gone_id, gone_sha, sha = (free_name(docs, c) for c in ("gone_id", "gone_sha", "sha"))
    gone = (exact_dedup(docs, text, doc_id).filter(~F.col("kept"))
            .select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha)).distinct())
    marked = docs.withColumn(sha, F.sha2(normalised(text).cast("binary"), 256))
    return marked.join(gone, (F.col(sha) == F.col(gone_sha)) & F.col(doc_id).eqNullSafe(F.col(gone_id)), "left_anti").drop(sha)

"""Parquet tables of a scale-factor folder and the labelled row sets built
from them.

A *row set* has the common schema ``row_id bigint, features array<double>,
label double`` (label +1 / -1) plus any key columns of the source table.
All features are plain column expressions, so the parquet scan only reads
the columns they use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Fixed values of the lineitem "charge" row set: the scaling constants of the
# four features and the threshold of the label (chosen so that the classes
# are separable by a margin; scaling by constants keeps the rows independent
# of each other, so no extra pass over the data is needed).
LINEITEM_CENTER = {"l_quantity": 25.0, "l_extendedprice": 50000.0,
                   "l_discount": 0.05, "l_tax": 0.04}
LINEITEM_SCALE = {"l_quantity": 15.0, "l_extendedprice": 30000.0,
                  "l_discount": 0.03, "l_tax": 0.03}
CHARGE_THRESHOLD = 30000.0
LINEITEM_KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def charge_label() -> F.Column:
    charge = (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
              * (F.lit(1.0) + F.col("l_tax")))
    return F.when(charge > F.lit(CHARGE_THRESHOLD), F.lit(1.0)).otherwise(F.lit(-1.0))


def lineitem_features(columns=("l_quantity", "l_extendedprice", "l_discount", "l_tax")):
    return F.array(*[(F.col(c) - F.lit(LINEITEM_CENTER[c])) / F.lit(LINEITEM_SCALE[c])
                     for c in columns])


def lineitem_row_id() -> F.Column:
    # lineitem has no single-column key; a 64-bit hash of the full key is a
    # stable id. It is only carried and used as a tie-break, never joined on.
    return F.xxhash64(*[F.col(c) for c in LINEITEM_KEYS])


def lineitem_rows(spark: SparkSession, sf_dir: str,
                  columns=("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
                  keep_keys: bool = True) -> DataFrame:
    """lineitem as labelled rows: scaled numeric columns, label "charge"."""
    li = table(spark, sf_dir, "lineitem")
    cols = [lineitem_row_id().alias("row_id"),
            lineitem_features(columns).alias("features"),
            charge_label().alias("label")]
    if keep_keys:
        cols = [F.col(k) for k in LINEITEM_KEYS] + cols
    return li.select(*cols)


def embedding_rows(spark: SparkSession, sf_dir: str, positive_label: int = 0) -> DataFrame:
    """embeddings as labelled rows: all dims as doubles, label +1 for one class."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.when(F.col("label") == F.lit(positive_label), F.lit(1.0))
        .otherwise(F.lit(-1.0)).alias("label"),
        F.col("label").alias("class_label"))


def word_count(col: str = "text") -> F.Column:
    """Number of whitespace separated tokens of the whole text."""
    return F.size(F.filter(F.split(F.col(col), r"\s+"), lambda t: t != F.lit("")))


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a quality label: log1p(characters), log1p(words)."""
    # features are computed on the documents side first, so the join shuffles
    # (doc_id, two doubles) instead of the whole texts
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.array(F.log1p(F.col("n_chars").cast("double")),
                          F.log1p(word_count("text").cast("double"))).alias("features"))
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == F.lit(1), F.lit(1.0)).otherwise(F.lit(-1.0))
        .alias("label"))
    return docs.join(labels, "doc_id", "inner").select(
        F.col("doc_id").alias("row_id"), "features", "label")

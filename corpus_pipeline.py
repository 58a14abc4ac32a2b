"""A training corpus from ``documents`` in stages, each on what the stage
before kept. ``run(spark, sf_dir)`` applies them; every stage's result is
written to the shared folder and read again by the next one.

Nulls: a null text counts as empty in every stage, null ids are compared
null-safely. Repeated rows and ties: one of equal texts stays (the longest
original, then the smallest id), the mix may repeat rows. Very long texts are
read whole in every stage. Extra columns pass through, also ones named like a
stage's own; ``n_tokens``, ``token_ids`` and ``round_trip`` are replaced by the
last stage. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kernelspark.llm.common import shared_table
from kernelspark.llm.exact_dedup import drop_exact_copies
from kernelspark.llm.mixing import mixed_documents
from kernelspark.llm.piece_tokenizer import encode_documents
from kernelspark.llm.quality import keep_good
from kernelspark.llm.simhash import drop_near_copies

#: The tokenizer's model file, read by the driver.
TOKENIZER_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts (operator 1), trained on
    these documents with the training part of ``labels``."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays (operator 8)."""
    return drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the
    smallest id (operator 5)."""
    return drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights; documents repeat where a
    source needs more than one epoch (operator 10)."""
    return mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, checked by decoding (operator 4):
    n_tokens, token_ids and round_trip are added."""
    with open(TOKENIZER_MODEL, "rb") as f:
        return encode_documents(docs, f.read())


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("SimHash near-dedup", without_near_copies),
    ("mixing sources", mixed),
    ("SentencePiece encoding", encoded),
]

#: The classifier and the tokenizer have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared_table(docs, name.replace(" ", "-"))
    return docs

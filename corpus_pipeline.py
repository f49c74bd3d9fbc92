"""The corpus pipeline: quality classifier, exact dedup, near-duplicate join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's result as Parquet in the shared
folder and reads it again as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from signalframe.llm import exact_dedup, mixing, ngram_join, packing, quality_classifier
from signalframe.llm.common import documents, labels, materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier expects to be of the top grade.

    A null text is scored as an empty one; repeated ids stay if one of their rows does; without labels all rows stay.
    """
    return quality_classifier.keep_good(docs, labels(spark, sf_dir))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one of the largest id. Null counts as empty; rows that repeat an id and text stay together."""
    return exact_dedup.keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id: five-word shingles, similarity of 0.8 or more.

    Texts without a word are in no group. Rows that repeat an id and text stay together; null ids come last.
    """
    return ngram_join.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which their sources mix to the stated target weights. A null source is a source; repeated ids share a place."""
    return mixing.mixed(docs, mixing.TARGETS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of at most 2048 tokens, which follow the mixed order.

    A null text is the end token alone; rows that repeat an id are packed each by itself. Files keep no order of rows, so the positions are computed again; they depend on ids, sources and weights only.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), order=mixing.positions(docs, mixing.TARGETS))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: The classifier is trained here, so SQL cannot express the pipeline; its test compares it with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs

"""The training-data pipeline: stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swipelake.llm import credentials, jaccard, mixing, packing, toxicity
from swipelake.llm.registered import DOCS, cyclic_weights, table, toxic_marks, vocabulary_path
from swipelake.scratch import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.calm_transactions(docs, toxic_marks(spark, sf_dir), DOCS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: 80 % of the five-word windows are the same."""
    return jaccard.distinct_transactions(docs, DOCS, size=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets masked in the text and ``n_chars`` counted anew."""
    shown = credentials.masked(docs, DOCS)
    if "n_chars" not in docs.columns:
        return shown
    return shown.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the words of each source come near its target."""
    return mixing.mixed(docs, cyclic_weights(docs), DOCS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and place."""
    return packing.pack_sequences(docs, vocabulary_path(), DOCS)


STAGES: list[tuple[str, Stage]] = [
    ("without_toxic", without_toxic),
    ("without_near_copies", without_near_copies),
    ("without_secrets", without_secrets),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

# Tokenizing, boosted trees and weighted cuts by them cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = written(docs, name)
    return docs

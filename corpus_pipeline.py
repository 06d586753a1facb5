"""A training corpus from raw documents: quality rules, exact and near deduplication, mixing, packing.

Every stage takes the documents its predecessor kept, in the columns of the table ``documents``, and returns them in
the same columns; the last one returns the packed pieces. Stages are written and read again, so none repeats another's
work when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from introspark.llm import exact_dedup, mixing, ngram_join, packing, quality_rules
from introspark.llm.common import documents, land, ship_package, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and consist mostly of content lines."""
    ship_package(spark)
    return quality_rules.keep_good(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels"), neighbours=False))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by 5-word shingle similarity of 0.75 or more."""
    ship_package(spark)
    return ngram_join.keep_one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; repeated epochs are repeated rows."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences of 2048 tokens."""
    ship_package(spark)
    return packing.pack(docs, packing.word_bpe()).drop("ids")


STAGES: list[tuple[str, Stage]] = [("quality_rules", quality), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mixed), ("packing", packed)]

#: The CRF of the first stage has no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents(spark, sf_dir)
    for name, stage in STAGES:
        out = land(stage(spark, out, sf_dir), f"stage-{name}")
    return out

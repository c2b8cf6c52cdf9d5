"""Corpus pipeline: quality filter, line dedup, near-dedup, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import bpe, common, line_dedup, packing, quality, simhash
from spendlens.llm.queries import VOCABULARY


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. NULL and empty texts are judged like others."""
    return quality.with_scores(docs, common.table(spark, sf_dir, "labels")).filter("predicted = 1").select("row.*")


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that they share with others; NULL texts become ''."""
    return line_dedup.drop_shared_lines(docs).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each near-duplicate group."""
    return simhash.one_of_each_group(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents, their tokens and an end mark, in training sequences, one row per piece."""
    return packing.pack(docs, bpe.n_ids(F.col("text"), VOCABULARY) + 1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("line dedup", line_filter),
    ("simhash near-dedup", near_dedup),
    ("best-fit packing", pack),
]

#: Classifier, fingerprints and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

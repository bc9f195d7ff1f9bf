"""The corpus pipeline: stages that each read what the one before has kept.

Quality rules drop documents, the n-gram join keeps one document of each group
of near duplicates, substring dedup cuts repeated passages out of texts, and
packing gives each document its place in a training sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm import bin_packing, ngram_join, quality_rules, substring_dedup
from ridgeline.llm.shared import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, Scratch(spark, "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, Scratch(spark, "near"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeats(docs, Scratch(spark, "passages"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bin_packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("best_fit_packing", packing),
]

#: SQL has no counterpart for content-defined cuts and packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, path = Scratch(spark, "pipeline"), None
    for _, stage in STAGES:
        docs, new_path = scratch.table(stage(spark, docs, sf_dir))
        if path:
            scratch.drop(path)
        path = new_path
    return docs

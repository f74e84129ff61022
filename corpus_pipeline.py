"""The corpus pipeline: each stage calls one operator on all that the stage before it kept.

run() applies the stages to `documents`; each result is written as Parquet and read again. All
stages but the last return the columns of documents; the last returns the pieces of packed
sequences. SQL can't express a trained field, a forest or a tokenizer, so there is no ORACLE_SQL.

Defined results: null, empty and blank texts have no words, so the rules reject them; rows are judged and
kept one by one, whatever ids they share or lack, and of rows equal in id and text one stays; texts of any
length are read whole; an empty table gives an empty result; extra columns pass through all stages but the
last.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import curve_packing, line_dedup, minhash_forest, quality_rules, secret_scan
from lorekeep.llm.common import table, written
from lorekeep.sources.reach import reachable

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the labelled lines reject go."""
    return quality_rules.keep_good(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or near to an earlier one go; documents left without a word go too."""
    return line_dedup.dedup_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash_forest.keep_first(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secret_scan.mask_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens along the curve."""
    return curve_packing.pack(docs, public_tokenizers.path(curve_packing.VOCABULARY), with_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(reachable(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""A training-data pipeline over documents: five stages, each from one operator.

run() chains the stages as one plan per stage; a driver may also write each
stage's result and hand it to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderloom.llm import byte_bpe, mixing, quality, secret_scan, simhash
from orderloom.llm._shared import keep, materialize, remove, scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the compression bands reject."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component."""
    return simhash.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks live credentials in the texts; widely copied examples stay."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source to its target, documents repeated by epochs."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts to byte-level BPE ids, and decodes those."""
    return byte_bpe.encode_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mix", mix),
    ("encode", encode),
]
#: zstandard, XXH64 fingerprints and BPE have no counterpart in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over the written results of the others; what only an earlier stage read is deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = keep(materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
        if before is not None:
            remove(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

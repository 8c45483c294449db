"""From raw documents to a training mix: language ID, line de-duplication, near-duplicates, decontamination, mixing.

Each stage reads what its predecessor kept. A document that language ID calls ``und`` goes; repeated lines go; of each group of
near duplicates the document with the smallest id stays; documents with a benchmark item go; the last stage returns what the mix
takes of each document that it takes at all.

Defined cases: documents with null text, or without a letter, go with the first stage; those without an id are judged like others
and never removed as copies; rows that share an id but not a text are told apart by their text; a document that lost all its lines
goes on with an empty text and is taken with 0 words, so it is not in the result; very long texts are read whole; an empty table
gives an empty result; other columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gapline.llm import cross_parsing, decontaminate, line_dedup, mixing, simhash
from gapline.llm.common import Scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cross_parsing.keep_known(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of the documents of which the mix takes words."""
    return mixing.mix(docs).filter("taken > 0")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("mixing", source_mix),
]

#: Fuzzy lines, fingerprints and cross-parsing have no counterpart in SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs

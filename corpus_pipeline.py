"""Documents to token ids: language, quality, near-duplicates, benchmark overlap, byte-pair encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import bpe, decontamination, langid, quality, similar
from tallyspark.llm.base import table
from tallyspark.llm.queries import TOKENIZER
from tallyspark.session import stored, tune


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a posterior of a half or more stay."""
    tune(spark)
    return langid.in_known_language(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers give a quality of a half or more stay."""
    tune(spark)
    return quality.of_good_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group that five-word shingles link at a similarity of 0.8 or more."""
    tune(spark)
    return similar.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item stay."""
    tune(spark)
    return decontamination.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, as little-endian 32-bit integers, with digests of the ids and the text."""
    tune(spark)
    return bpe.round_trip(docs, TOKENIZER)


STAGES = [
    ("language_id", known_language),
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: No SQL: classifiers and verified fingerprints have no counterpart there.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

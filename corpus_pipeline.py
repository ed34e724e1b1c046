"""Corpus preparation: five stages over the documents table, each one of the library's operators with its decisions applied."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import jaccard_join, langid, line_dedup, packing, suffix_dedup
from sluice.llm.common import read_documents, save


def recount(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where there is such a column; of a null text it stays as it was."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the classifier knows; those without any letter, null and empty ones go."""
    return langid.keep_known(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that had occurred before go, and with them documents of which nothing is left."""
    return recount(line_dedup.keep_some(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at a similarity of 0.8 or more, the document of the least doc_id stays."""
    groups = jaccard_join.join(docs, words=5, num=8, den=10)
    later = groups.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has go."""
    return recount(suffix_dedup.keep_first(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 4,096 tokens."""
    return packing.pack(docs, "word_bpe_49k.json", end_id=1, capacity=4096)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix_dedup_stage),
    ("best_fit_packing", best_fit_packing),
]

#: A trained classifier is no SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

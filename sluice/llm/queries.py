"""The queries of this subpackage, one per operator, with the settings used in production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, langid, line_dedup, media, packing, periodic, suffix_dedup, token_files, toxicity, tree_bpe, warc, whitening, winnowing
from .common import read_documents


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(read_documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(read_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "text")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(read_documents(spark, sf_dir))


def op4_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_bpe.encode(read_documents(spark, sf_dir), "byte_bpe_50k.json", digests=True)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir), "word_bpe_49k.json", end_id=1, capacity=4096)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read_documents(spark, sf_dir), "word_bpe_49k.json", end_id=2)


def op8_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(read_documents(spark, sf_dir))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_likeness(read_documents(spark, sf_dir))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read_documents(spark, sf_dir), words=4, num=85, den=100)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find(periodic.looped(read_documents(spark, sf_dir))))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that 64 bits do not hold is null."""
    found = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_line_dedup, op3_suffix_dedup, op4_bpe_tree, op5_toxicity, op6_best_fit_packing, op7_token_files, op8_media_chunks, op9_winnowing, op10_jaccard_join, op11_periodic_runs, op12_whitening, op13_warc)
}
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": line_dedup.ORACLE, "op13_warc": warc.ORACLE}

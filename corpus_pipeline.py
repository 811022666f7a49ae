"""From raw documents to token ids: five stages, each written as Parquet and read by the next.

A stage is (name, function of (spark, docs, sf_dir)); all but the last return the columns of docs, whatever their names.
Texts of any length are read whole; an empty table passes every stage as an empty table with its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_rules
from maskwright.llm.common import write_table
from maskwright.llm.queries import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the strict policy (which includes the base rules). Null and empty texts have no words, so they go;
    null ids and repeated rows are judged row by row."""
    return quality_rules.apply_policy(quality_rules.evaluate_rules(docs), quality_rules.STRICT)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted; documents of which nothing is left go, those that were empty before
    stay. What is later goes by id, then line; see `line_dedup` for null ids and repeated rows."""
    return line_dedup.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; five words, 0.8. Texts without words are linked with
    nothing and stay; see `jaccard_join` for null ids, repeated rows and equal smallest ids."""
    return jaccard_join.keep_one(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go. Null and empty texts and items contain nothing; an empty benchmark keeps all."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of the decoded text; null texts count as empty, null ids stay null,
    repeated rows give repeated results."""
    return bpe.digests(bpe.encode(docs, vocabulary_path()))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("decontamination", decontamination), ("bpe", tokens)]

#: BPE is beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

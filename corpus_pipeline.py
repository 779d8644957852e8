"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronoweave.llm import decontam, langid_kn, line_runs, mixing_soft, neardup_hamming
from chronoweave.session import materialize, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go: those without a letter, null texts too, and those that fit no language. Repeated rows fare alike."""
    return langid_kn.accepted(docs, langid_kn.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay in the one with the largest id only. Null texts and rows without an id stay as they are."""
    return line_runs.cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the smallest id stays; rows without an id stay."""
    found = neardup_hamming.classes(docs, size=5, similarity=0.8)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go. Null and empty texts stay; repeated rows fare alike."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its rate (mix_rate) and number of copies (mix_copies). Null texts have no tokens and a rate all the same; rows without an id are rated too."""
    model = mixing_soft.fit(docs, table(spark, sf_dir, "labels"))
    rated = mixing_soft.Mix(docs, model).rated(docs, model)
    return rated.withColumn("mix_copies", mixing_soft.copies(F.col("mix_rate")))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL can express neither the language models nor the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

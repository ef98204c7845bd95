"""A corpus from raw documents to packed sequences, in four stages.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
it kept; its result is written as Parquet and read again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import jaccard_join, line_dedup, packing, quality
from panelspark.llm.shared import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the rules or the likelihood ratio reject go."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: passages of earlier documents go; a document that loses all its words goes with them."""
    left = line_dedup.line_dedup(docs)
    gone = (F.col("lines_deleted") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    left = left.where(F.coalesce(~gone, F.lit(True)))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("lines_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(docs.columns)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group of near copies stays."""
    return jaccard_join.without_near_copies(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: what is left, packed into sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("jaccard_join", near_copies_stage),
    ("best_fit_packing", packing_stage),
]

#: Neither the likelihood ratio nor patience diff can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

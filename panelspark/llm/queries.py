"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_automaton, conversation_repair, jaccard_join, language_model, license_scan, line_dedup, metric_search, packing, quality, rank_merge, suffix_dedup, token_store, vector_codes
from .shared import shared_folder

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_decode(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE), digests_only=True)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(documents(spark, sf_dir))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-store")
    token_store.write_store(documents(spark, sf_dir), folder, public_tokenizers.path(BYTE_BPE), end_id=2)
    return token_store.read_store(spark, folder, with_ids=False)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir)).drop("spans")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), capacity=1024, end_id=2)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_search.exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, every=50)


#: Against brute force; a row's own number tells the query's own row from others of its id.
OP6_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.own <> c.own AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_merge.token_counts(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.line_dedup(documents(spark, sf_dir))
    text = F.coalesce("text", F.lit(""))
    return left.select("doc_id", "lines_total", "lines_deleted", F.length(text).cast("long").alias("n_chars_left"), F.sha2(text, 256).alias("text_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = vector_codes.label_errors(found.codes)
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversation_repair.repair(turns).withColumnRenamed("conv", "conv_id")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir), with_kept=False).drop("kept", "spans")


QUERIES = (
    op1_bpe_automaton,
    op2_jaccard_join,
    op3_token_store,
    op4_license_scan,
    op5_best_fit_packing,
    op6_exact_top_k,
    op7_quality_rules,
    op8_token_counts,
    op9_language_model,
    op10_line_dedup,
    op11_vector_codes,
    op12_conversation_repair,
    op13_suffix_dedup,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_top_k": OP6_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

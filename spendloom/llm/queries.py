"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.llm.columns import table
from spendloom.llm.embedding_dedup import near_duplicate_vectors
from spendloom.llm.hard_negatives import NEGATIVES_SQL, hard_negatives
from spendloom.llm.licences import scan_licences
from spendloom.llm.line_rules import clean_lines, cleaning_sql
from spendloom.llm.mixing import mix_sources
from spendloom.llm.near_dedup import near_duplicates
from spendloom.llm.nearest import nearest_vectors
from spendloom.llm.packing import pack_documents
from spendloom.llm.quality import held_out, score_quality
from spendloom.llm.ranked_search import SEARCH_SQL, ranked_search
from spendloom.llm.repeats import repeated_passages
from spendloom.llm.sharding import shard_by_bytes
from spendloom.llm.token_counts import token_counts

VOCABULARY = "byte_bpe_50k.json"


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))[0]


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path(VOCABULARY))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "clean_text")


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_nearest_neighbours, op3_quality_classifier, op4_substring_dedup, op5_licence_scan, op6_sharding, op7_minhash_near_dedup, op8_best_fit_packing, op9_token_counts, op10_source_mixing, op11_ranked_search, op12_hard_negatives, op13_quality_rules)}
SQL: dict[str, str] = {"op11_ranked_search": SEARCH_SQL, "op12_hard_negatives": NEGATIVES_SQL, "op13_quality_rules": cleaning_sql()}

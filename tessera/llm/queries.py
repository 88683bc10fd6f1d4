"""Queries of the llm operators over the tables of a data folder; SQL is in ``oracles.py``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bm25, bpe, exact_dedup, language_id, ngram_join, packing, pii, suffix_dedup, token_counts, toxicity

#: Key of the surrogates in these queries; a deployment passes its own secret.
PII_KEY = b"tessera query key"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(_documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    got = exact_dedup.annotate(docs)
    return got.select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language_id.fit(docs, ~language_id.held_out())
    got = language_id.predict(docs.select("doc_id", "text"), model).withColumn("doc_id", F.col("row.doc_id"))
    return got.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op4_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20 is a query, by all its terms, against all documents."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    index = bm25.build_index(docs)
    found = bm25.search(index, bm25.query_terms(docs, index, F.col("doc_id") % 20 == 0, terms=None))
    return found.withColumn("rank", F.col("rank").cast("long")).withColumn("score", F.round("score", 6))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.pseudonymise(_documents(spark, sf_dir).select("doc_id", "text"), PII_KEY)
    return got.select(F.col("row.doc_id").alias("doc_id"), "n_replaced", F.sha2(F.coalesce("new_text", F.lit("")), 256).alias("text_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), digest=True)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.remove_repeats(_documents(spark, sf_dir))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language_id": op3_language_id,
    "op4_bm25": op4_bm25,
    "op5_pii": op5_pii,
    "op6_token_counts": op6_token_counts,
    "op7_packing": op7_packing,
    "op8_bpe": op8_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_suffix_dedup": op10_suffix_dedup,
}

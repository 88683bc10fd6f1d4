"""Training-corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir).  All
stages but the last return the columns of ``documents``.  No stage can be
expressed in SQL as a whole (``ORACLE_SQL`` is None); ``tests/llm`` holds the run
against brute-force versions of its stages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, language_id, ngram_join, packing, pii
from tessera.llm.common import small_batches, stash
from tessera.llm.queries import PII_KEY

ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected; the others carry the predicted language."""
    docs = docs.select(*COLUMNS)
    model = language_id.fit(docs, ~language_id.held_out())
    kept = language_id.predict(docs, model).filter("accepted")
    return kept.select("row.doc_id", "row.text", F.col("lang_pred").alias("lang"), "row.source", "row.n_chars")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.dedup(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more of their five-word shingles the smallest id stays.

    Documents without words are linked with nothing and stay.  The dropped ids go
    as a Bloom filter of at most 8 MB and are then joined exactly, so only
    documents that may go are shuffled.
    """
    classes = ngram_join.similarity_classes(docs, width=5, percent=80)
    gone = stash(classes.filter("doc_id <> component_id").select("doc_id"), "near_copies")
    return ngram_join.without(docs.select(*COLUMNS), gone)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    got = pii.pseudonymise(docs.select(*COLUMNS), PII_KEY)
    return got.select("row.doc_id", F.col("new_text").alias("text"), "row.lang", "row.source", F.length("new_text").cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, ids included."""
    pieces = packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("sequence_id", "offset", "doc_id", "start", "length", "doc_tokens", "ids")


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """All stages run on the same executors, which keep what the largest of them took."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    (name, in_small_batches(stage))
    for name, stage in [
        ("language_id", identify_language),
        ("exact_dedup", drop_copies),
        ("ngram_join", drop_near_copies),
        ("pii", replace_personal_data),
        ("packing", pack_sequences),
    ]
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, name)
    return docs

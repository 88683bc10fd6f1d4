"""Chunks: scans, reference counts, deduplication, scrubbing, eviction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chunk_scan(files: DataFrame, chunk: int) -> DataFrame:
    """(path, idx, id, size): fixed-size pieces with their SHA-256; the last may be short, an empty file has none."""
    count = F.ceil(F.col("size") / F.lit(chunk))
    pieces = files.filter("size > 0").select("path", "ns", "content", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("idx"))
    data = F.substring("content", (F.col("idx") * chunk + 1).cast("int"), F.lit(chunk))
    return pieces.select("path", "ns", "idx", F.sha2(data, 256).alias("id"), F.octet_length(data).cast("long").alias("size"))


def chunk_counts(files: DataFrame, chunk: int) -> DataFrame:
    """(path, n_chunks, last_size)."""
    n = F.ceil(F.col("size") / F.lit(chunk))
    return files.select("path", n.cast("long").alias("n_chunks"), F.when(F.col("size") == 0, 0).otherwise(F.least(F.lit(chunk), F.col("size") - (n - 1) * chunk)).cast("long").alias("last_size"))


def refcounts(references: DataFrame) -> DataFrame:
    """(id, refcount): every reference counts, repeats within a version too."""
    return references.groupBy("id").agg(F.count(F.lit(1)).alias("refcount"))


def dedup_summary(references: DataFrame, by: list[str] | None = None) -> DataFrame:
    """referenced_bytes, unique_bytes, n_chunks, n_distinct: two-phase, so a chunk of very many references is combined first."""
    keys = by or []
    per = references.groupBy(*keys, "id").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(
        F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).alias("referenced_bytes"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("unique_bytes"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"),
        F.count(F.lit(1)).alias("n_distinct"),
    )


def drift(stored: DataFrame, counted: DataFrame, key: str, value: str) -> DataFrame:
    """(key, stored, counted) where they differ, over the union of keys; a missing side counts 0."""
    a, b = stored.select(key, F.col(value).alias("stored")), counted.select(key, F.col(value).alias("counted"))
    both = a.join(b, key, "full_outer")
    s, c = F.coalesce("stored", F.lit(0)), F.coalesce("counted", F.lit(0))
    return both.select(key, s.alias("stored"), c.alias("counted")).filter("stored <> counted")


def scrub(copies: DataFrame) -> DataFrame:
    """(path, idx, id, actual) of the copies (path, idx, id, data) whose bytes do not hash to their id; null data is unreadable and corrupt."""
    actual = F.sha2("data", 256)
    return copies.select("path", "idx", "id", actual.alias("actual")).filter(F.col("actual").isNull() | (F.col("actual") != F.col("id")))


def evict(quarantine: DataFrame, cap: int, name: str = "name", mtime: str = "mtime", size: str = "size", keys: list[str] | None = None) -> DataFrame:
    """What stays when the oldest are evicted until the total is at most ``cap``; ties by name."""
    w = Window.partitionBy(*(keys or [])).orderBy(F.desc(mtime), F.desc(name)).rowsBetween(Window.unboundedPreceding, 0)
    return quarantine.withColumn("newer_bytes", F.sum(size).over(w)).filter(F.col("newer_bytes") <= cap)


def usage(copies: DataFrame) -> DataFrame:
    """(n_chunks, bytes) of a store."""
    return copies.agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def stripe_layout(chunks: DataFrame) -> DataFrame:
    """(id, shard_bytes, block_bytes, ec_bytes, rf3_bytes): 4 + 2 stripes with a 33-byte block head against three copies."""
    shard = F.ceil(F.col("size") / 4).cast("long")
    return chunks.select("id", shard.alias("shard_bytes"), (shard + 33).alias("block_bytes"), (6 * (shard + 33)).alias("ec_bytes"), (3 * F.col("size")).alias("rf3_bytes"))


def claim_waves(claims: DataFrame, present: DataFrame, wave: int = 4) -> DataFrame:
    """(version, idx, id, action): chunks already present are skipped; one that repeats within a wave is put once and else marked deduped."""
    w = Window.partitionBy("version", "wave", "id").orderBy("idx")
    waved = claims.withColumn("wave", F.floor(F.col("idx") / wave).cast("long")).withColumn("n", F.row_number().over(w))
    known = waved.join(present.select("id", F.lit(True).alias("have")).distinct(), "id", "left")
    return known.select("version", "idx", "id", "wave", F.when(F.col("have"), "present").when(F.col("n") > 1, "deduped").otherwise("put").alias("action"))

"""Sources and sinks: content-addressed stores, CSV tables, JSON timelines, key files, metrics text, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def block_store(spark: SparkSession, folder: str) -> DataFrame:
    """(id, size, ok) of the chunks stored at ab/cd/<sha-256> below ``folder``; other names are skipped."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    b = b.withColumn("id", name).filter(F.col("id").rlike("^[0-9a-f]{64}$") & F.col("path").endswith(F.concat(F.lit("/"), F.substring("id", 1, 2), F.lit("/"), F.substring("id", 3, 2), F.lit("/"), F.col("id"))))
    return b.select("id", F.col("length").alias("size"), (F.sha2("content", 256) == F.col("id")).alias("ok"))


def put_chunks(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (id, data) to append: those that hash to their id and are not stored yet, each once."""
    good = new.filter(F.sha2("data", 256) == F.col("id")).dropDuplicates(["id"])
    return good.join(stored.select("id"), "id", "left_anti")


def delete_chunks(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """What stays; deleting an absent chunk succeeds."""
    return stored.join(ids.select("id"), "id", "left_anti")


def read_table(spark: SparkSession, path: str, text: list[str], numbers: list[str]) -> DataFrame:
    """CSV with a head; bad numbers become 0."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*text, *[F.coalesce(F.expr(f"try_cast(`{c}` AS double)"), F.lit(0.0)).alias(c) for c in numbers])


def write_table(df: DataFrame, path: str) -> None:
    """CSV with a head; doubles have three decimals."""
    df.select(*[F.format_string("%.3f", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]).write.option("header", True).mode("overwrite").csv(path)


def timeline(spark: SparkSession, path: str) -> DataFrame:
    """(seed, scenario, seq, atMs, kind, node, text) of JSON timelines."""
    j = spark.read.option("multiLine", True).json(path)
    return j.select("seed", "scenario", F.explode("events").alias("e")).select("seed", "scenario", "e.*")


def key_problems(keys: DataFrame) -> DataFrame:
    """(ns, problem) of a key file (ns, hash, quota): duplicates and negative quotas."""
    dup = lambda c, what: keys.groupBy(c).agg(F.count(F.lit(1)).alias("n"), F.min("ns").alias("m")).filter("n > 1").select(F.col("m").alias("ns"), F.lit(what).alias("problem"))
    return dup("ns", "duplicate namespace").unionAll(dup("hash", "duplicate key")).unionAll(keys.filter("quota < 0").select("ns", F.lit("negative quota").alias("problem")))


def allowed(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """``requests`` (hash, path) with whether the key's namespace covers the path; unknown keys are refused."""
    r = requests.join(keys.select("hash", "ns"), "hash", "left")
    return r.withColumn("allowed", F.coalesce(F.col("path").startswith(F.concat(F.lit("/"), F.col("ns"), F.lit("/"))), F.lit(False)))


def metrics_text(metrics: DataFrame) -> DataFrame:
    """(line) in the text exposition format, by name; ``metrics``: (name, kind, label, label_value, value)."""
    label = F.when(F.col("label").isNotNull(), F.concat(F.lit("{"), "label", F.lit('="'), "label_value", F.lit('"}'))).otherwise("")
    rows = metrics.select("name", F.lit(1).alias("o"), F.coalesce("label_value", F.lit("")).alias("k"), F.concat("name", label, F.lit(" "), F.col("value").cast("string")).alias("line"))
    heads = metrics.groupBy("name").agg(F.min("kind").alias("kind")).select("name", F.lit(0).alias("o"), F.lit("").alias("k"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), "kind").alias("line"))
    return rows.unionAll(heads).orderBy("name", "o", "k").select("line")


def save_snapshot(tables: dict[str, DataFrame], folder: str, at: int) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/at={at}/{name}")


def load_snapshot(spark: SparkSession, folder: str, at: int, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/at={at}/{n}") for n in names}


def compact(log: DataFrame, at: int) -> DataFrame:
    """Log entries that a snapshot at ``at`` leaves."""
    return log.filter(F.col("log_index") > at)

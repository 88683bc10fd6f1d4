"""Logical tables of a storage cluster over the driver's test tables, and their DuckDB form.

Each function takes (spark, dir) and returns one table; ``SQL`` has the same
tables as common table expressions for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 256
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_tax", "l_discount", "l_returnflag", "l_linestatus"]


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, ns, content, size): one file per document."""
    d = read(spark, folder, "documents")
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return d.select(F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("source").alias("ns"), content.alias("content"), F.octet_length(content).cast("long").alias("size"))


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """(path, v, size, tombstone, epoch): one version per order of a customer."""
    o = read(spark, folder, "orders")
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    first = o.agg(F.min(month)).first()[0] or 0
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(
        F.col("o_custkey").alias("path"),
        F.row_number().over(w).cast("long").alias("v"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("size"),
        (F.col("o_orderstatus") == "P").alias("tombstone"),
        (month - first).cast("long").alias("epoch"),
    )


def version_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(version, idx, id, size): the chunk list of every version."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    li = read(spark, folder, "lineitem").select("l_orderkey", F.col("l_partkey").alias("id"), (F.row_number().over(w) - 1).cast("long").alias("idx"))
    size = read(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("size"))
    return li.join(size, "id").select(F.col("l_orderkey").alias("version"), "idx", "id", "size")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(id, size): one chunk per part."""
    return read(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("size"))


def locations(spark: SparkSession, folder: str) -> DataFrame:
    """(id, node): which node has a copy of which chunk."""
    return read(spark, folder, "lineitem").filter((F.col("l_partkey") + F.col("l_suppkey")) % 10 == 0).select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("node")).distinct()


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """(node, rack, used, alive, slow, admin)."""
    used = locations(spark, folder).join(chunks(spark, folder), "id").groupBy("node").agg(F.sum("size").alias("used"))
    racks = read(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("rack"))
    s = read(spark, folder, "supplier").join(racks, "s_nationkey").withColumnRenamed("s_suppkey", "node").join(used, "node", "left")
    return s.select(
        "node", F.col("rack").cast("long").alias("rack"), F.coalesce("used", F.lit(0)).alias("used"), (F.col("node") % 7 != 0).alias("alive"), (F.col("node") % 11 == 0).alias("slow"),
        F.when(F.col("node") % 13 == 0, "draining").otherwise("active").alias("admin"),
    )


def heartbeats(spark: SparkSession, folder: str) -> DataFrame:
    """(node, seq, t, restarted): t in microseconds."""
    e = read(spark, folder, "events")
    return e.select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), (F.col("event_type") == "signup").alias("restarted"))


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """(node, chunk, action, seq, is_full)."""
    e = read(spark, folder, "events")
    return e.select(
        F.col("user_id").alias("node"), (F.col("event_id") % 50).alias("chunk"), F.when(F.col("event_type") == "error", "delete").otherwise("add").alias("action"), F.col("event_id").alias("seq"),
        (F.col("event_type") == "purchase").alias("is_full"),
    )


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, op, latency_us, t): t in microseconds."""
    e = read(spark, folder, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("client"), F.col("event_type").alias("op"), F.round(F.col("value") * 1000).cast("long").alias("latency_us"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))


def history(spark: SparkSession, folder: str) -> DataFrame:
    """(path, pos, kind, version): a client history with some stale versions planted by rule."""
    o = read(spark, folder, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    pos = F.row_number().over(w)
    kind = F.when(F.col("o_orderstatus") == "P", "delete").otherwise("put")
    return o.select(F.col("o_custkey").alias("path"), pos.cast("long").alias("pos"), kind.alias("kind"), (pos + F.when(F.col("o_orderkey") % 97 == 0, 1).otherwise(0)).cast("long").alias("version"))


SQL = {
    "files": "files AS (SELECT '/' || source || '/' || doc_id AS path, source AS ns, hex(encode(coalesce(text, ''))) AS content, octet_length(encode(coalesce(text, ''))) AS size FROM documents)",
    "versions": """versions AS (
        SELECT o_custkey AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS v,
               CAST(round(o_totalprice * 100) AS BIGINT) AS size, o_orderstatus = 'P' AS tombstone,
               year(o_orderdate) * 12 + month(o_orderdate) - (SELECT min(year(o_orderdate) * 12 + month(o_orderdate)) FROM orders) AS epoch
        FROM orders)""",
    "version_chunks": f"""version_chunks AS (
        SELECT l_orderkey AS version, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) - 1 AS idx, l_partkey AS id, CAST(p_size AS BIGINT) AS size
        FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "chunks": "chunks AS (SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS size FROM part)",
    "locations": "locations AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS node FROM lineitem WHERE (l_partkey + l_suppkey) % 10 = 0)",
    "nodes": """nodes AS (
        SELECT s_suppkey AS node, n_regionkey AS rack, CAST(coalesce(used, 0) AS BIGINT) AS used, s_suppkey % 7 <> 0 AS alive, s_suppkey % 11 = 0 AS slow,
               CASE WHEN s_suppkey % 13 = 0 THEN 'draining' ELSE 'active' END AS admin
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        LEFT JOIN (SELECT node, sum(size) AS used FROM locations JOIN chunks USING (id) GROUP BY node) u ON u.node = s_suppkey)""",
    "heartbeats": "heartbeats AS (SELECT user_id AS node, event_id AS seq, epoch_us(ts) AS t, event_type = 'signup' AS restarted FROM events)",
    "reports": "reports AS (SELECT user_id AS node, event_id % 50 AS chunk, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'add' END AS action, event_id AS seq, event_type = 'purchase' AS is_full FROM events)",
    "samples": "samples AS (SELECT event_id AS seq, user_id AS client, event_type AS op, CAST(round(value * 1000) AS BIGINT) AS latency_us, epoch_us(ts) AS t FROM events)",
    "history": """history AS (
        SELECT o_custkey AS path, row_number() OVER w AS pos, CASE WHEN o_orderstatus = 'P' THEN 'delete' ELSE 'put' END AS kind,
               row_number() OVER w + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS version
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))""",
}
_NEEDS = {"nodes": ["chunks", "locations"]}


def with_tables(names: list[str], query: str) -> str:
    """``query`` with the named tables before it."""
    order: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    return "WITH " + ",\n".join(SQL[x] for x in order) + "\n" + query

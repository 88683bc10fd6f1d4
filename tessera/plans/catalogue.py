"""The query catalogue: each query over a data folder, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import chunks, cluster, erasure, histories, oplog, repair, reports, versions
from tessera.sources import stores
from tessera.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
C = T.CHUNK
HOUR = 3_600_000_000
FACTOR = 3


def query(sql: str | None = None, needs: tuple[str, ...] = ()):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = T.with_tables(list(needs), sql) if needs else sql
        return fn

    return add


PIECES = f"""pieces AS (
    SELECT path, ns, idx, sha256(unhex(substr(content, CAST(2 * idx * {C} + 1 AS BIGINT), {2 * C}))) AS id, least({C}, size - idx * {C}) AS size
    FROM (SELECT *, unnest(range(0, CAST(ceil(size / {C}.0) AS BIGINT))) AS idx FROM files))"""


def _pieces(s, d):
    return chunks.chunk_scan(T.files(s, d), C)


@query(f", {PIECES} SELECT path, idx, id, size FROM pieces", ("files",))
def chunk_manifest(s, d):
    return _pieces(s, d).select("path", "idx", "id", "size")


@query(f"SELECT path, CAST(ceil(size / {C}.0) AS BIGINT) AS n_chunks, CASE WHEN size = 0 THEN 0 ELSE size - (CAST(ceil(size / {C}.0) AS BIGINT) - 1) * {C} END AS last_size FROM files", ("files",))
def chunk_counts(s, d):
    return chunks.chunk_counts(T.files(s, d), C)


_SUMS = "CAST(coalesce(sum(size * n), 0) AS BIGINT) AS referenced_bytes, CAST(coalesce(sum(size), 0) AS BIGINT) AS unique_bytes, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_chunks, count(*) AS n_distinct"


@query(f", {PIECES} SELECT {_SUMS} FROM (SELECT id, max(size) AS size, count(*) AS n FROM pieces GROUP BY id)", ("files",))
def dedup_summary(s, d):
    return chunks.dedup_summary(_pieces(s, d))


@query(f", {PIECES} SELECT ns, {_SUMS} FROM (SELECT ns, id, max(size) AS size, count(*) AS n FROM pieces GROUP BY ns, id) GROUP BY ns", ("files",))
def dedup_by_namespace(s, d):
    return chunks.dedup_summary(_pieces(s, d), ["ns"])


@query(f", {PIECES} SELECT count(*) AS n_chunks, CAST(sum(size) AS BIGINT) AS bytes FROM pieces", ("files",))
def store_usage(s, d):
    return chunks.usage(_pieces(s, d))


@query("SELECT id, count(*) AS refcount FROM version_chunks GROUP BY id", ("version_chunks",))
def refcounts(s, d):
    return chunks.refcounts(T.version_chunks(s, d))


@query("SELECT id, n + (id % 50 = 0)::INT AS stored, n AS counted FROM (SELECT id, count(*) AS n FROM version_chunks GROUP BY id) WHERE id % 50 = 0", ("version_chunks",))
def refcount_drift(s, d):
    counted = chunks.refcounts(T.version_chunks(s, d))
    stored = counted.withColumn("refcount", F.col("refcount") + (F.col("id") % 50 == 0).cast("int"))
    return chunks.drift(stored, counted, "id", "refcount")


@query(f", {PIECES} SELECT path, idx, id FROM pieces WHERE ascii(substr(id, 1, 1)) = 48 AND substr(id, 2, 1) = '0'", ("files",))
def scrub_check(s, d):
    """Copies whose id begins with 00 have rotted in the middle byte."""
    f = T.files(s, d)
    p = chunks.chunk_scan(f, C).join(f.select("path", "content"), "path")
    data = F.substring("content", (F.col("idx") * C + 1).cast("int"), F.lit(C))
    return chunks.scrub(p.withColumn("data", F.when(F.col("id").startswith("00"), scalars.rot(data)).otherwise(data))).select("path", "idx", "id")


@query("SELECT event_id AS name, user_id AS node, epoch_us(ts) AS mtime, CAST(round(value) AS BIGINT) AS size FROM events QUALIFY sum(CAST(round(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) <= 5000")
def quarantine_evict(s, d):
    e = T.read(s, d, "events").select(F.col("event_id").alias("name"), F.col("user_id").alias("node"), F.unix_micros(F.col("ts").cast("timestamp")).alias("mtime"), F.round("value").cast("long").alias("size"))
    return chunks.evict(e, 5000, keys=["node"]).select("name", "node", "mtime", "size")


@query("SELECT id, CAST(ceil(size / 4.0) AS BIGINT) AS shard_bytes, CAST(ceil(size / 4.0) AS BIGINT) + 33 AS block_bytes, 6 * (CAST(ceil(size / 4.0) AS BIGINT) + 33) AS ec_bytes, 3 * size AS rf3_bytes FROM chunks", ("chunks",))
def ec_overhead(s, d):
    return chunks.stripe_layout(T.chunks(s, d))


@query(
    """SELECT version, idx, id, wave, CASE WHEN id % 3 = 0 THEN 'present' WHEN n > 1 THEN 'deduped' ELSE 'put' END AS action
    FROM (SELECT *, idx // 4 AS wave, row_number() OVER (PARTITION BY version, idx // 4, id ORDER BY idx) AS n FROM version_chunks)""",
    ("version_chunks",),
)
def claim_waves(s, d):
    return chunks.claim_waves(T.version_chunks(s, d), T.chunks(s, d).filter("id % 3 = 0"))


# --- versions -------------------------------------------------------------------------------------------


@query("SELECT path, v, size FROM versions QUALIFY row_number() OVER (PARTITION BY path ORDER BY v DESC) = 1 AND NOT tombstone", ("versions",))
def live_versions(s, d):
    return versions.live(T.versions(s, d)).select("path", "v", "size")


_LOG = "log AS (SELECT *, lead(epoch) OVER (PARTITION BY path ORDER BY v) AS retired_at FROM versions)"


@query(f", {_LOG} SELECT path, v, size, tombstone, retired_at, retired_at + 12 AS expires FROM log", ("versions",))
def version_log(s, d):
    return versions.version_log(T.versions(s, d), 12)


@query(
    """, n AS (SELECT path, max(v) AS v FROM versions GROUP BY path),
    gone AS (SELECT path FROM versions JOIN n USING (path, v) WHERE tombstone)
    SELECT path, max(v) AS v, arg_max(size, v) AS size FROM versions WHERE NOT tombstone AND path IN (SELECT path FROM gone) GROUP BY path""",
    ("versions",),
)
def deleted_list(s, d):
    return versions.deleted(T.versions(s, d))


@query("SELECT path, size FROM files WHERE path LIKE '/src1%' ORDER BY path", ("files",))
def list_prefix(s, d):
    return T.files(s, d).filter(F.col("path").startswith("/src1")).select("path", "size").orderBy("path")


@query("SELECT v.path, v.v, v.size FROM versions v WHERE NOT tombstone AND v = 1 + path % 5", ("versions",))
def version_lookup(s, d):
    t = T.versions(s, d)
    return versions.lookup(t, t.select("path", (1 + F.col("path") % 5).alias("v")).distinct())


@query(f", {_LOG} SELECT path, v, retired_at FROM log WHERE retired_at + 12 <= 60", ("versions",))
def retention_sweep(s, d):
    return versions.sweep(T.versions(s, d), 12, 60)


@query("SELECT path AS upload, max(epoch) AS touched FROM versions GROUP BY path HAVING max(epoch) + 8 <= 80", ("versions",))
def lease_expiry(s, d):
    return versions.expired_leases(T.versions(s, d).select(F.col("path").alias("upload"), "epoch"), 8, 80)


@query("SELECT ns, CAST(sum(size) AS BIGINT) AS used FROM files GROUP BY ns HAVING sum(size) <> 0", ("files",))
def namespace_usage(s, d):
    f = T.files(s, d)
    return versions.namespace_usage(f.filter(F.xxhash64("path") % 3 != 0), f.filter(F.xxhash64("path") % 3 == 0))


@query(
    """SELECT ns, doc_id AS seq, size, CAST(before AS BIGINT) AS before FROM (
        SELECT source AS ns, doc_id, octet_length(encode(coalesce(text, ''))) AS size,
               coalesce(sum(octet_length(encode(coalesce(text, '')))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM documents) WHERE before + size > 100000"""
)
def quota_refusals(s, d):
    r = T.read(s, d, "documents").select(F.col("source").alias("ns"), F.col("doc_id").alias("seq"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    return versions.quota_refusals(r, r.select("ns").distinct().withColumn("quota", F.lit(100_000)))


_DIFF = """, a AS (SELECT version // 2 AS pair, idx, id, size FROM version_chunks WHERE version % 2 = 0),
    b AS (SELECT version // 2 AS pair, idx, id, size FROM version_chunks WHERE version % 2 = 1)
    SELECT pair, count(*) FILTER (a.id = b.id) AS same, count(*) FILTER (a.id <> b.id) AS changed, count_if(a.id IS NULL) AS added, count_if(b.id IS NULL) AS removed,
           CAST(coalesce(sum(CASE WHEN a.id = b.id THEN b.size END), 0) AS BIGINT) AS shared_bytes,
           CAST(coalesce(sum(CASE WHEN b.id IS NOT NULL AND a.id IS DISTINCT FROM b.id THEN b.size END), 0) AS BIGINT) AS new_bytes
    FROM a FULL JOIN b USING (pair, idx) GROUP BY pair"""


@query(_DIFF, ("version_chunks",))
def manifest_diff(s, d):
    t = T.version_chunks(s, d).withColumn("pair", F.expr("version div 2"))
    return versions.manifest_diff(t.filter("version % 2 = 0"), t.filter("version % 2 = 1"), ["pair"])


@query(
    """, r AS (SELECT version, idx, row_number() OVER w - 1 = idx AS in_run, bool_and(id % 4 <> 0) OVER (PARTITION BY version ORDER BY idx ROWS UNBOUNDED PRECEDING) AS ok
        FROM version_chunks WHERE (version + idx) % 7 <> 0 WINDOW w AS (PARTITION BY version ORDER BY idx))
    SELECT version, count_if(in_run) AS claimed_run, count_if(in_run AND ok) AS present_run FROM r GROUP BY version""",
    ("version_chunks",),
)
def resume_offset(s, d):
    t = T.version_chunks(s, d)
    return versions.resume_offset(t.filter("(version + idx) % 7 <> 0"), T.chunks(s, d).filter("id % 4 <> 0"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o + l > 4096 THEN 'out of range' WHEN o % 256 <> 0 THEN 'not a boundary' WHEN o > 2048 THEN 'beyond claimed'
           WHEN l % 256 <> 0 AND o + l <> 4096 THEN 'part of a chunk' WHEN o + l = 4096 THEN 'commit' ELSE 'accept' END AS verdict
    FROM (SELECT o_orderkey, (o_orderkey % 40) * 128 AS o, (o_custkey % 50) * 128 AS l FROM orders)"""
)
def append_checks(s, d):
    o = T.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") % 40) * 128).alias("offset"), ((F.col("o_custkey") % 50) * 128).alias("length"), F.lit(4096).alias("size"), F.lit(8).alias("claimed_run"))
    return versions.append_checks(o, 256).select("id", "verdict")


@query(
    """SELECT path, path LIKE '/%' AND path <> '/' AND len(list_filter(string_split(substr(path, 2), '/'), lambda x: x IN ('', '.', '..'))) = 0 AS valid, split_part(path, '/', 2) AS ns
    FROM (SELECT CASE doc_id % 6 WHEN 0 THEN '/' || source || '/' || doc_id WHEN 1 THEN source || '/' || doc_id WHEN 2 THEN '/' || source || '//' || doc_id WHEN 3 THEN '/' || source || '/../' || doc_id
                 WHEN 4 THEN '/' || source || '/' ELSE '/' || source || '/.' || doc_id END AS path FROM documents)"""
)
def path_checks(s, d):
    k, src, i = F.col("doc_id") % 6, F.col("source"), F.col("doc_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("/"), src, F.lit("/"), i)).when(k == 1, F.concat(src, F.lit("/"), i)).when(k == 2, F.concat(F.lit("/"), src, F.lit("//"), i))
    path = path.when(k == 3, F.concat(F.lit("/"), src, F.lit("/../"), i)).when(k == 4, F.concat(F.lit("/"), src, F.lit("/"))).otherwise(F.concat(F.lit("/"), src, F.lit("/."), i))
    return T.read(s, d, "documents").select(path.alias("path")).select("path", versions.valid_path(F.col("path")).alias("valid"), versions.namespace(F.col("path")).alias("ns"))


# --- cluster --------------------------------------------------------------------------------------------

_DETECT = f""", g AS (SELECT *, t - lag(t) OVER (PARTITION BY node ORDER BY t, seq) AS gap FROM heartbeats),
    i AS (SELECT *, sum((coalesce(gap > {24 * HOUR}, false) OR (restarted AND gap IS NOT NULL))::INT) OVER w AS seg, sum((coalesce(gap > {12 * HOUR}, false) OR (restarted AND gap IS NOT NULL))::INT) OVER w AS run
          FROM g WINDOW w AS (PARTITION BY node ORDER BY t, seq ROWS UNBOUNDED PRECEDING)),
    n AS (SELECT *, row_number() OVER (PARTITION BY node, seg, run ORDER BY t, seq) AS rn FROM i),
    st AS (SELECT node, seq, t, CASE WHEN seg = 0 OR max((rn >= 3)::INT) OVER (PARTITION BY node, seg ORDER BY t, seq ROWS UNBOUNDED PRECEDING) = 1 THEN 'alive' ELSE 'suspect' END AS state FROM n)"""


@query(f"{_DETECT} SELECT node, seq, t, state FROM st", ("heartbeats",))
def detector_states(s, d):
    return cluster.detector(T.heartbeats(s, d), 12 * HOUR, 24 * HOUR)


@query(
    f"""{_DETECT}, x AS (SELECT *, lead(t) OVER (PARTITION BY node ORDER BY t, seq) AS nt FROM st),
    p AS (SELECT node, seq, t, state FROM x
          UNION ALL SELECT node, seq, t + {24 * HOUR}, 'suspect' FROM x WHERE nt IS NULL OR t + {24 * HOUR} < nt
          UNION ALL SELECT node, seq, t + {72 * HOUR}, 'dead' FROM x WHERE nt IS NULL OR t + {72 * HOUR} < nt),
    c AS (SELECT *, lag(state) OVER (PARTITION BY node ORDER BY t, seq, state) AS was FROM p)
    SELECT node, t, state FROM c WHERE was IS NULL OR was <> state""",
    ("heartbeats",),
)
def detector_transitions(s, d):
    return cluster.transitions(T.heartbeats(s, d), 12 * HOUR, 24 * HOUR, 72 * HOUR)


@query("SELECT node, max(seq) AS seq, arg_max(t, seq) AS t, count(*) AS beats FROM heartbeats GROUP BY node", ("heartbeats",))
def latest_nodes(s, d):
    return cluster.latest_nodes(T.heartbeats(s, d))


@query("SELECT node, seq, t FROM heartbeats QUALIFY seq > coalesce(max(seq) OVER (PARTITION BY node ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)", ("heartbeats",))
def heartbeat_dedupe(s, d):
    return cluster.deduplicate_beats(T.heartbeats(s, d).withColumn("incarnation", F.lit(0))).select("node", "seq", "t")


@query(
    """, b AS (SELECT node, max(seq) AS base FROM reports WHERE is_full GROUP BY node),
    r AS (SELECT reports.*, base FROM reports LEFT JOIN b USING (node) WHERE base IS NULL OR seq > base OR (seq = base AND is_full))
    SELECT node, chunk FROM (SELECT node, chunk, action FROM r QUALIFY row_number() OVER (PARTITION BY node, chunk ORDER BY seq DESC, action DESC) = 1) WHERE action = 'add'""",
    ("reports",),
)
def report_reconcile(s, d):
    return cluster.reconcile_reports(T.reports(s, d))


@query("SELECT node, seq, seq % 5 <> 0 OR coalesce(seq <= (SELECT max(f.seq) FROM reports f WHERE f.is_full AND f.node = r.node), false) AS received FROM reports r", ("reports",))
def report_confirm(s, d):
    r = T.reports(s, d)
    return cluster.confirm_reports(r.select("node", "seq"), r.filter("seq % 5 <> 0").select("node", "seq"), r.filter("is_full").select("node", "seq"))


@query(
    """, k AS (SELECT DISTINCT node, chunk FROM reports WHERE seq % 2 = 0), l AS (SELECT DISTINCT node, chunk FROM reports WHERE seq % 3 = 0)
    SELECT coalesce(k.node, l.node) AS node, coalesce(k.chunk, l.chunk) AS chunk, CASE WHEN k.node IS NULL THEN 'added' ELSE 'removed' END AS change
    FROM k FULL JOIN l ON k.node = l.node AND k.chunk = l.chunk WHERE k.node IS NULL OR l.node IS NULL""",
    ("reports",),
)
def report_deltas(s, d):
    r = T.reports(s, d)
    return cluster.report_deltas(r.filter("seq % 2 = 0").select("node", "chunk").distinct(), r.filter("seq % 3 = 0").select("node", "chunk").distinct())


_COPIES = """, copies AS (SELECT c.id, c.size, count_if(coalesce(n.alive, false)) AS alive, count(n.node) AS readable
    FROM chunks c LEFT JOIN locations l USING (id) LEFT JOIN nodes n USING (node) GROUP BY c.id, c.size)"""


def _copies(s, d):
    return cluster.replicas(T.chunks(s, d), T.locations(s, d), T.nodes(s, d))


@query("SELECT l.id, l.node FROM locations l JOIN nodes n USING (node) WHERE alive AND NOT (l.id % 9 = 0 AND l.node % 2 = 0) AND NOT (l.id % 11 = 0 AND l.node % 3 = 0)", ("nodes",))
def live_locations(s, d):
    loc = T.locations(s, d)
    return cluster.live_locations(loc, T.nodes(s, d), loc.filter("id % 9 = 0 and node % 2 = 0"), loc.filter("id % 11 = 0 and node % 3 = 0"))


@query(f"{_COPIES} SELECT least(alive, {FACTOR + 1}) AS copies, count(*) AS n_chunks FROM copies GROUP BY 1", ("nodes",))
def replica_histogram(s, d):
    return cluster.replica_histogram(_copies(s, d), FACTOR)


@query(f"{_COPIES} SELECT count_if(readable = 0) AS lost, count_if(alive < {FACTOR}) AS under, count_if(alive > {FACTOR}) AS over, count(*) AS n_chunks FROM copies", ("nodes",))
def chunk_health(s, d):
    return cluster.health(_copies(s, d), FACTOR)


@query(f"{_COPIES} SELECT version, least(min(alive), {FACTOR}) AS min_copies, count_if(alive < {FACTOR}) AS below FROM version_chunks v JOIN copies USING (id) GROUP BY version", ("nodes", "version_chunks"))
def file_health(s, d):
    return cluster.file_health(T.version_chunks(s, d), _copies(s, d), FACTOR)


@query("SELECT node, count(*) AS n_chunks, CAST(sum(size) AS BIGINT) AS bytes FROM locations JOIN chunks USING (id) GROUP BY node", ("chunks", "locations"))
def node_usage(s, d):
    return cluster.node_usage(T.locations(s, d), T.chunks(s, d))


@query(
    f"""{_COPIES}, g AS (SELECT (id - 1) // 6 AS stripe, sum(least(readable, 1)) AS readable, sum(least(alive, 1)) AS alive, max(alive) AS most FROM copies GROUP BY 1 HAVING count(*) = 6)
    SELECT stripe, CAST(readable AS BIGINT) AS readable, CAST(alive AS BIGINT) AS alive, CASE WHEN readable < 4 THEN 'lost' WHEN alive < 6 THEN 'under' WHEN most > 1 THEN 'over' ELSE 'ok' END AS state FROM g""",
    ("nodes",),
)
def stripe_health(s, d):
    c = _copies(s, d)
    shards = c.select(F.expr("(id - 1) div 6").alias("stripe"), ((F.col("id") - 1) % 6).alias("slot"), "id")
    whole = shards.groupBy("stripe").count().filter("count = 6").select("stripe")
    return cluster.stripe_health(shards.join(whole, "stripe"), c)


@query(
    """, r AS (SELECT id, string_agg(CAST(node AS VARCHAR), ',' ORDER BY NOT alive, slow, node) AS replicas FROM locations JOIN nodes USING (node) GROUP BY id)
    SELECT version, idx, id, size, coalesce(replicas, '') AS replicas FROM version_chunks LEFT JOIN r USING (id)""",
    ("nodes", "version_chunks"),
)
def manifest_with_replicas(s, d):
    return cluster.manifest(T.version_chunks(s, d), T.locations(s, d), T.nodes(s, d))


_MARKED = ", marked AS (SELECT DISTINCT id FROM version_chunks WHERE version % 97 = 0 UNION SELECT id FROM version_chunks WHERE version % 101 = 1 UNION SELECT id FROM chunks WHERE id % 6 = 0)"


def _marked(s, d):
    v = T.version_chunks(s, d)
    return cluster.marked(v.filter("version % 97 = 0"), v.filter("version % 101 = 1"), T.chunks(s, d).filter("id % 6 = 0"))


@query(f"{_MARKED} SELECT id FROM marked", ("chunks", "version_chunks"))
def marked_set(s, d):
    return _marked(s, d)


@query(f"{_MARKED} SELECT id, node FROM locations WHERE id NOT IN (SELECT id FROM marked)", ("chunks", "version_chunks", "locations"))
def orphan_chunks(s, d):
    return cluster.orphans(T.locations(s, d), _marked(s, d))


@query(
    """, k AS (SELECT seq % 200 AS id, t, seq % 7 <> 0 AS orphan, seq FROM heartbeats),
    s AS (SELECT id, t, bool_and(orphan) AS orphan FROM k GROUP BY id, t),
    i AS (SELECT *, sum((NOT orphan)::INT) OVER (PARTITION BY id ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM s),
    f AS (SELECT *, min(t) OVER (PARTITION BY id, island) AS first_seen FROM i WHERE orphan)
    SELECT id, first_seen, min(t) AS t FROM f WHERE t - first_seen >= 172800000000 GROUP BY id, first_seen""",
    ("heartbeats",),
)
def gc_candidates(s, d):
    h = T.heartbeats(s, d).select((F.col("seq") % 200).alias("id"), "t", (F.col("seq") % 7 != 0).alias("orphan"))
    return cluster.collectable(h.groupBy("id", "t").agg(F.bool_and("orphan").alias("orphan")), 48 * HOUR)


@query("SELECT id, rack, count(*) AS copies FROM locations JOIN nodes USING (node) GROUP BY id, rack", ("nodes",))
def rack_counts(s, d):
    return cluster.rack_counts(T.locations(s, d), T.nodes(s, d))


@query("SELECT CASE WHEN alive THEN 'alive' ELSE 'dead' END AS state, count(*) AS n FROM nodes GROUP BY 1", ("nodes",))
def node_states(s, d):
    return cluster.node_states(T.nodes(s, d))


@query(f"SELECT id, CAST({FACTOR} AS BIGINT) AS target FROM chunks WHERE id % 4 <> 0 UNION ALL SELECT id, 1 FROM chunks WHERE id % 4 = 0", ("chunks",))
def wanted_blocks(s, d):
    c = T.chunks(s, d)
    return cluster.wanted_blocks(c.filter("id % 4 <> 0"), c.filter("id % 2 = 0"), FACTOR)


@query(
    """, sh AS (SELECT (id - 1) // 6 AS stripe, (id - 1) % 6 AS slot, id FROM chunks)
    SELECT a.stripe, a.slot, b.slot AS sibling_slot, node FROM sh a JOIN sh b ON a.stripe = b.stripe AND a.slot <> b.slot JOIN locations l ON l.id = b.id JOIN nodes USING (node) WHERE alive""",
    ("nodes",),
)
def stripe_siblings(s, d):
    sh = T.chunks(s, d).select(F.expr("(id - 1) div 6").alias("stripe"), ((F.col("id") - 1) % 6).alias("slot"), "id")
    return cluster.siblings(sh, T.locations(s, d).join(T.nodes(s, d).filter("alive").select("node"), "node"))


@query(
    """, r AS (SELECT DISTINCT seq // 1000 AS t, chunk AS id, node FROM reports), k AS (SELECT DISTINCT seq // 1000 AS t, chunk AS id, node FROM reports WHERE action = 'delete'),
    p AS (SELECT t, rank() OVER (ORDER BY t) AS probe FROM (SELECT DISTINCT t FROM r)),
    m AS (SELECT r.*, probe, probe - row_number() OVER (PARTITION BY id, node ORDER BY r.t) AS island FROM r JOIN p USING (t) WHERE NOT EXISTS (FROM k WHERE k.t = r.t AND k.id = r.id AND k.node = r.node))
    SELECT id, node, min(t) AS since, max(t) AS until FROM m GROUP BY id, node, island HAVING max(t) - min(t) > 0""",
    ("reports",),
)
def phantom_copies(s, d):
    r = T.reports(s, d).select(F.expr("seq div 1000").alias("t"), F.col("chunk").alias("id"), "node", "action")
    return cluster.phantoms(r.drop("action").distinct(), r.filter("action = 'delete'").drop("action").distinct(), 0)


@query(
    f"""{_COPIES} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM nodes WHERE alive) AS n_alive, count(*) AS n_chunks,
        CAST(sum(size) AS BIGINT) AS unique_bytes, CAST(sum(size * readable) AS BIGINT) AS stored_bytes FROM copies""",
    ("nodes",),
)
def cluster_totals(s, d):
    n = T.nodes(s, d).agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if("alive").alias("n_alive")).withColumn("k", F.lit(1))
    c = _copies(s, d).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("size").alias("unique_bytes"), F.sum(F.col("size") * F.col("readable")).alias("stored_bytes")).withColumn("k", F.lit(1))
    return n.join(c, "k").drop("k")


# --- repair ---------------------------------------------------------------------------------------------


@query(f"{_COPIES} SELECT CAST(CASE WHEN alive = 0 THEN 0 ELSE 1 END AS BIGINT) AS class, alive AS rank, id FROM copies WHERE alive < {FACTOR} AND readable > 0", ("nodes",))
def repair_queue(s, d):
    return repair.repair_queue(_copies(s, d), FACTOR)


@query(
    f"""{_COPIES}, use AS (SELECT id, rack, count(*) AS n FROM locations JOIN nodes USING (node) GROUP BY id, rack)
    SELECT c.id, n.node AS target FROM copies c CROSS JOIN nodes n LEFT JOIN use u ON u.id = c.id AND u.rack = n.rack
    WHERE c.alive < {FACTOR} AND c.readable > 0 AND n.alive AND n.admin = 'active' AND NOT EXISTS (FROM locations l WHERE l.id = c.id AND l.node = n.node)
    QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY coalesce(u.n, 0), n.slow, n.used, n.node) = 1""",
    ("nodes",),
)
def repair_targets(s, d):
    loc, nodes = T.locations(s, d), T.nodes(s, d)
    return repair.repair_targets(repair.repair_queue(_copies(s, d), FACTOR).select("id"), loc, nodes, cluster.rack_counts(loc, nodes))


@query(
    f""", h AS (SELECT l.id, l.node, n.rack, n.used, count(*) OVER (PARTITION BY l.id) AS copies, count(*) OVER (PARTITION BY l.id, n.rack) AS on_rack FROM locations l JOIN nodes n USING (node) WHERE n.alive)
    SELECT id, node AS victim FROM h WHERE copies > {FACTOR} QUALIFY row_number() OVER (PARTITION BY id ORDER BY on_rack DESC, used DESC, node DESC) = 1""",
    ("nodes",),
)
def trim_victims(s, d):
    return repair.trim_victims(T.locations(s, d), T.nodes(s, d), FACTOR)


@query(
    f""", h AS (SELECT l.id, l.node, n.admin, count_if(n.alive AND n.admin = 'active') OVER (PARTITION BY l.id) AS elsewhere FROM locations l JOIN nodes n USING (node))
    SELECT node, count_if(elsewhere < {FACTOR}) AS short FROM h WHERE admin = 'draining' GROUP BY node""",
    ("nodes",),
)
def decommission_short(s, d):
    return repair.short_elsewhere(T.locations(s, d), T.nodes(s, d), FACTOR)


@query(
    f"""{_COPIES} SELECT c.id, l.node AS source FROM copies c JOIN locations l USING (id) JOIN nodes n USING (node) WHERE c.alive < {FACTOR} AND c.readable > 0
    QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY NOT n.alive, n.used, l.node) = 1""",
    ("nodes",),
)
def repair_sources(s, d):
    return repair.source_choice(repair.repair_queue(_copies(s, d), FACTOR), T.locations(s, d), T.nodes(s, d))


_TARGETS = """, tot AS (SELECT CAST(sum(used) AS BIGINT) AS total, CAST(sum(used) AS BIGINT) // 4 AS cap FROM nodes),
    rk AS (SELECT rack, count(*) AS n FROM nodes GROUP BY rack),
    ord AS (SELECT *, row_number() OVER (ORDER BY n DESC, rack) - 1 AS i, coalesce(sum(n) OVER (ORDER BY n DESC, rack ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS alln FROM rk),
    fi AS (SELECT coalesce(min(i), (SELECT count(*) FROM rk)) AS f FROM ord, tot WHERE NOT CAST((total - i * cap) * n AS BIGINT) // CAST(alln - before AS BIGINT) > cap),
    le AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM ord, fi WHERE i >= f),
    tg AS (SELECT nodes.node, nodes.rack, used, CAST(CASE WHEN i < f THEN cap // ord.n ELSE (total - f * cap) // le.n END AS BIGINT) AS target FROM nodes JOIN ord USING (rack), tot, fi, le)"""


def _targets(s, d):
    nodes = T.nodes(s, d)
    total = nodes.agg(F.sum("used")).first()[0]
    return repair.balance_targets(nodes, total, total // 4)


@query(f"{_TARGETS} SELECT node, rack, used, target FROM tg", ("nodes",))
def rebalance_targets(s, d):
    return _targets(s, d)


@query(f"{_TARGETS} SELECT CAST(sum(abs(used - target)) AS BIGINT) AS l1, count_if(used - target > 200) AS n_over, count_if(used - target < -200) AS n_under, count_if(abs(used - target) > 200) = 0 AS balanced FROM tg", ("nodes",))
def rebalance_l1(s, d):
    return repair.balance(_targets(s, d), 200)


@query(
    """, e AS (SELECT id, list_sort(list(node * 10)) AS ex FROM locations WHERE node % 3 = 0 GROUP BY id)
    SELECT id, ex[CAST(id % 3 + len(ex) - 3 AS BIGINT) + 1] AS ready FROM e WHERE id % 3 + len(ex) - 3 >= 0 AND id % 3 + len(ex) - 3 < len(ex)""",
    ("locations",),
)
def repair_ready(s, d):
    loc = T.locations(s, d)
    return repair.ready_times(loc.filter("node % 3 = 0").select("id", (F.col("node") * 10).alias("expires")), loc.select("id").distinct().withColumn("live", F.col("id") % 3), 3)


@query()
def place_replicas(s, d):
    return repair.place(T.chunks(s, d), T.nodes(s, d))


@query()
def rebalance_plan(s, d):
    hold = T.locations(s, d).join(T.chunks(s, d), "id").join(T.nodes(s, d).select("node", "rack"), "node").select("id", "node", "rack", "size")
    return repair.move_plan(_targets(s, d), hold, 200, 16)


@query()
def repair_dispatch(s, d):
    loc, nodes = T.locations(s, d), T.nodes(s, d)
    q = repair.repair_queue(_copies(s, d), FACTOR)
    q = q.join(repair.source_choice(q, loc, nodes), "id").join(repair.repair_targets(q.select("id"), loc, nodes, cluster.rack_counts(loc, nodes)), "id")
    return repair.dispatch(q)


# --- reports --------------------------------------------------------------------------------------------

_P = "l[CAST(least(len(l) - 1, len(l) * {} // 100) AS BIGINT) + 1]"


@query(f", g AS (SELECT op, list_sort(list(latency_us)) AS l FROM samples GROUP BY op) SELECT op, len(l) AS samples, {_P.format(50)} AS p50, {_P.format(95)} AS p95, {_P.format(99)} AS p99 FROM g", ("samples",))
def latency_percentiles(s, d):
    return reports.nearest_rank(T.samples(s, d), ["op"], "latency_us", [50, 95, 99])


_DAY0 = "(SELECT min(t) FROM samples)"
_WEEK = 7 * 24 * HOUR


@query(
    f""", p AS (SELECT *, CASE (t - {_DAY0}) // {_WEEK} WHEN 0 THEN 'baseline' WHEN 1 THEN 'detecting' WHEN 2 THEN 'copying' WHEN 3 THEN 'repaired' END AS phase FROM samples),
    g AS (SELECT phase, op, list_sort(list(latency_us)) AS l FROM p WHERE phase IS NOT NULL GROUP BY phase, op)
    SELECT phase, op, len(l) AS samples, {_P.format(50)} AS p50, {_P.format(99)} AS p99 FROM g""",
    ("samples",),
)
def phase_latency(s, d):
    x = T.samples(s, d)
    t0 = x.agg(F.min("t")).first()[0] or 0
    phases = [(n, t0 + i * _WEEK, t0 + (i + 1) * _WEEK) for i, n in enumerate(("baseline", "detecting", "copying", "repaired"))]
    return reports.nearest_rank(reports.in_phases(x, phases), ["phase", "op"], "latency_us", [50, 99])


@query(
    f""", r AS (SELECT client, latency_us FROM samples QUALIFY row_number() OVER (PARTITION BY client ORDER BY t DESC, seq DESC) <= 128), g AS (SELECT client, list_sort(list(latency_us)) AS l FROM r GROUP BY client)
    SELECT client, len(l) AS samples, CAST(CASE WHEN len(l) < 16 THEN 100000 ELSE greatest(20000, least(500000, {_P.format(95)})) END AS BIGINT) AS delay_us FROM g""",
    ("samples",),
)
def hedge_delays(s, d):
    return reports.hedge_delay(T.samples(s, d), ["client"])


@query("SELECT seq // 2 AS call, min(latency_us + (seq % 2) * 20000) AS latency_us FROM samples GROUP BY 1", ("samples",))
def hedged_latency(s, d):
    return reports.hedged(T.samples(s, d).select(F.expr("seq div 2").alias("call"), (F.col("seq") % 2).alias("attempt"), "latency_us"), 20_000)


@query("SELECT seq // 3 AS call, list_sort(list(latency_us))[2] + 1000 AS latency_us FROM samples GROUP BY 1", ("samples",))
def quorum_latency(s, d):
    return reports.quorum(T.samples(s, d).select(F.expr("seq div 3").alias("call"), "latency_us"), 2, 1000)


@query("SELECT op, CASE WHEN latency_us > 400000 THEN 'failed' ELSE 'ok' END AS outcome, count(*) AS n FROM samples GROUP BY 1, 2", ("samples",))
def outcome_tally(s, d):
    return reports.tally(T.samples(s, d).withColumn("outcome", F.when(F.col("latency_us") > 400_000, "failed").otherwise("ok")), ["op", "outcome"])


@query(
    """, c AS (SELECT client AS node, t, seq, seq // 500 AS leader, latency_us AS value FROM samples),
    x AS (SELECT node, CASE WHEN leader = lag(leader) OVER w AND value >= lag(value) OVER w THEN value - lag(value) OVER w ELSE 0 END AS dv FROM c WINDOW w AS (PARTITION BY node ORDER BY t, seq))
    SELECT node, CAST(sum(dv) AS BIGINT) AS total FROM x GROUP BY node""",
    ("samples",),
)
def leader_deltas(s, d):
    return reports.leader_deltas(T.samples(s, d).select(F.col("client").alias("node"), "t", "seq", F.expr("seq div 500").alias("leader"), F.col("latency_us").alias("value")))


@query(
    """, e AS (SELECT op, t AS tm, 1 AS d FROM samples UNION ALL SELECT op, t + latency_us * 10000, -1 FROM samples), g AS (SELECT op, tm, d, sum(d) AS ds FROM e GROUP BY ALL)
    SELECT op, CAST(max(l) AS BIGINT) AS peak FROM (SELECT op, sum(ds) OVER (PARTITION BY op ORDER BY tm, d ROWS UNBOUNDED PRECEDING) AS l FROM g) GROUP BY op""",
    ("samples",),
)
def peak_inflight(s, d):
    return reports.peak_in_flight(T.samples(s, d).select("op", F.col("t").alias("start"), (F.col("t") + F.col("latency_us") * 10_000).alias("end")), ["op"])


@query("SELECT op, count(*) AS runs, round(CAST(sum(CAST(4096 / 1048576.0::DOUBLE / (latency_us / 1e6) AS DECIMAL(28, 9))) AS DOUBLE) / count(*), 3) AS mib_s FROM samples WHERE latency_us > 0 GROUP BY op", ("samples",))
def throughput(s, d):
    return reports.throughput(T.samples(s, d).select("op", F.lit(4096).alias("bytes"), F.col("latency_us").alias("us")), ["op"])


@query("SELECT client % 5 AS rack, count(*) AS samples, list_sort(list(latency_us))[count(*) // 2 + 1] AS median FROM samples WHERE latency_us > 0 GROUP BY 1", ("samples",))
def median_service(s, d):
    return reports.upper_median(T.samples(s, d).withColumn("rack", F.col("client") % 5), ["rack"], "latency_us")


@query(
    """, m AS (SELECT list_sort(list(latency_us))[count(*) // 2 + 1] AS m FROM samples WHERE latency_us > 0), a AS (SELECT client AS node, CAST(sum(latency_us) AS BIGINT) // count(*) AS score FROM samples GROUP BY 1)
    SELECT node, score, score > greatest(m + 2000, 101 * m // 100) AS slow FROM a, m""",
    ("samples",),
)
def slow_nodes_candidates(s, d):
    x = T.samples(s, d)
    m = reports.upper_median(x.withColumn("all", F.lit(1)), ["all"], "latency_us").first().median or 0
    a = x.groupBy(F.col("client").alias("node")).agg(F.expr("sum(latency_us) div count(1)").alias("score"))
    return a.withColumn("slow", F.col("score") > max(m + 2000, 101 * m // 100))


@query("SELECT op, min(seq) AS first FROM samples GROUP BY op", ("samples",))
def first_seen(s, d):
    return reports.first_seen(T.samples(s, d), "op", "seq")


@query("SELECT op, client % 10 AS k, arg_min(latency_us, seq) AS latency_us FROM samples GROUP BY 1, 2", ("samples",))
def first_match(s, d):
    return reports.first_match(T.samples(s, d).withColumn("k", F.col("client") % 10), ["op", "k"], "seq", "latency_us")


@query("SELECT seq, op FROM samples WHERE seq > greatest(100, (SELECT max(seq) FROM samples) - 500)", ("samples",))
def timeline_recent(s, d):
    return reports.ring_after(T.samples(s, d).select("seq", "op"), 100)


@query(
    """SELECT op, CASE WHEN op = 'purchase' THEN 'good' WHEN op = 'error' THEN 'bad' WHEN op = 'signup' THEN 'warn' ELSE 'plain' END AS tone, count(*) AS n FROM samples GROUP BY 1, 2""",
    ("samples",),
)
def timeline_counts(s, d):
    return reports.tally(T.samples(s, d).withColumn("tone", reports.tone(F.col("op"))), ["op", "tone"])


@query()
def token_bucket(s, d):
    return reports.token_bucket(T.samples(s, d).withColumn("n", F.lit(1)), "client", 1 / 36_000, 3.0)


@query(
    """, o AS (SELECT client, seq, latency_us AS v, row_number() OVER (PARTITION BY client ORDER BY t, seq) AS n FROM samples),
    r AS (SELECT client, seq, v AS score, n FROM o WHERE n = 1
          UNION ALL SELECT o.client, o.seq, CASE WHEN r.score = 0 THEN o.v ELSE r.score + sign(o.v - r.score)::BIGINT * (abs(o.v - r.score) // 4) END, o.n FROM r JOIN o ON o.client = r.client AND o.n = r.n + 1)
    SELECT client, seq, score FROM r""",
    ("samples",),
)
def ewma_scores(s, d):
    return reports.ewma(T.samples(s, d), "client")


ORACLES["ewma_scores"] = ORACLES["ewma_scores"].replace("WITH ", "WITH RECURSIVE ", 1)


@query()
def slow_flags(s, d):
    x = T.samples(s, d)
    return reports.slow_flags(reports.ewma(x, "client").join(x.select("seq", "t"), "seq").withColumn("median", F.lit(60_000)), "client")


@query()
def peak_rate(s, d):
    return reports.peak_rate(T.samples(s, d).select("client", "t", "seq", F.col("latency_us").alias("bytes")), "client", HOUR)


# --- log and histories ----------------------------------------------------------------------------------


@query(
    """, w AS (SELECT client, seq AS save, latency_us % 64 AS index, greatest(0, latency_us % 64 - latency_us % 3) AS first FROM samples)
    SELECT client, save, first, index FROM w a WHERE NOT EXISTS (FROM w b WHERE b.client = a.client AND b.save > a.save AND b.first <= a.index)""",
    ("samples",),
)
def wal_effective_log(s, d):
    i = F.col("latency_us") % 64
    w = T.samples(s, d).select("client", F.col("seq").alias("save"), F.greatest(F.lit(0), i - F.col("latency_us") % 3).alias("first"), i.alias("index"))
    return oplog.effective(w, ["client"])


@query(
    """, r AS (SELECT client, seq AS pos, latency_us % 40 <> 0 AS ok FROM samples)
    SELECT client, min(CASE WHEN NOT ok THEN pos END) AS first_bad, CASE WHEN min(CASE WHEN NOT ok THEN pos END) IS NULL THEN 'clean' WHEN min(CASE WHEN NOT ok THEN pos END) = max(pos) THEN 'torn' ELSE 'corrupt' END AS verdict FROM r GROUP BY client""",
    ("samples",),
)
def wal_tail(s, d):
    return oplog.tail(T.samples(s, d).select("client", F.col("seq").alias("pos"), (F.col("latency_us") % 40 != 0).alias("ok")), ["client"])


@query(
    """, c AS (SELECT client AS node, t, seq, seq // 100 - (latency_us % 3) AS term FROM samples)
    SELECT node, t, seq, term FROM c QUALIFY term < max(term) OVER (PARTITION BY node ORDER BY t, seq ROWS UNBOUNDED PRECEDING)""",
    ("samples",),
)
def fenced_commands(s, d):
    return oplog.fenced(T.samples(s, d).select(F.col("client").alias("node"), "t", "seq", (F.expr("seq div 100") - F.col("latency_us") % 3).alias("term")))


@query(
    """, h AS (SELECT *, coalesce(lag(version) OVER (PARTITION BY path ORDER BY pos), 0) + 1 AS expected FROM history)
    SELECT path, pos, kind, version, expected FROM h WHERE version <> expected""",
    ("history",),
)
def history_violations(s, d):
    return histories.violations(T.history(s, d))


@query("SELECT path, CASE WHEN count_if(version <> pos) = 0 THEN 'ok' ELSE 'bad' END AS verdict FROM history GROUP BY path", ("history",))
def linearizable(s, d):
    """Puts only, one after the other: linearizable exactly if versions count up."""
    h = T.history(s, d).select("path", F.lit("put").alias("kind"), (F.col("pos") * 10).cast("double").alias("call"), (F.col("pos") * 10 + 5).cast("double").alias("end"), F.lit("ok").alias("class"), "version", F.lit("x").alias("hash"))
    return histories.linearizable(h)


@query(
    """SELECT event_id AS seq, kind, outcome, CASE WHEN outcome IN ('ok', 'conflict') THEN outcome WHEN outcome = 'notfound' AND kind <> 'put' THEN 'notfound' ELSE 'ambiguous' END AS class
    FROM (SELECT event_id, ['put', 'get', 'delete', 'list'][event_id % 4 + 1] AS kind, ['ok', 'conflict', 'notfound', 'failed'][user_id % 4 + 1] AS outcome FROM events) WHERE NOT (outcome = 'failed' AND kind IN ('get', 'list'))"""
)
def history_classes(s, d):
    pick = lambda c, *v: F.get(F.array(*map(F.lit, v)), (c % 4).cast("int"))
    e = T.read(s, d, "events").select(F.col("event_id").alias("seq"), pick(F.col("event_id"), "put", "get", "delete", "list").alias("kind"), pick(F.col("user_id"), "ok", "conflict", "notfound", "failed").alias("outcome"))
    return histories.classify(e)




def _ops(s, d):
    """An op log: each order begins an upload of one chunk on its customer's path, claims it and commits it; pending orders delete first."""
    o = T.read(s, d, "orders").groupBy("o_orderkey").agg(F.min("o_custkey").alias("c"), F.min("o_totalprice").alias("p"), F.min("o_orderstatus").alias("st"))
    k = F.col("o_orderkey")
    row = lambda i, op, up: F.struct((k * 4 + i).alias("log_index"), F.lit(op).alias("op"), F.lit(up).alias("has"))
    o = o.withColumn("e", F.explode(F.array(row(0, "delete", False), row(1, "begin", True), row(2, "claim", True), row(3, "commit", True)))).filter("e.op <> 'delete' or st = 'P'")
    n = F.dense_rank().over(Window.orderBy("o_orderkey"))  # ids of uploads are global; the log is small
    return o.withColumn("u", n.cast("long")).select(
        "e.log_index", "e.op", F.concat(F.lit("r"), k.cast("string")).alias("request"), F.concat(F.lit("/c"), (F.col("c") % 10).cast("string"), F.lit("/"), F.col("c").cast("string")).alias("path"),
        F.concat(F.lit("c"), (F.col("c") % 10).cast("string")).alias("ns"), F.when(F.col("e.op") == "delete", 0).otherwise(-1).cast("long").alias("expected"), "u", F.lit(0).cast("long").alias("idx"), F.lit("x").alias("id"),
        F.lit(1).cast("long").alias("n_chunks"), F.round(F.col("p") * 100).cast("long").alias("size"), F.lit(0).cast("long").alias("version"), F.lit(0).cast("long").alias("epochs"),
    ).withColumnRenamed("u", "upload")


@query()
def oplog_state(s, d):
    return oplog.fold(_ops(s, d))


@query(
    """, f AS (SELECT *, unhex(content) AS b FROM files WHERE size > 0)
    SELECT sha256(b) AS id, count(*) AS copies, sha256(b) AS decoded FROM f GROUP BY 1, 3""",
    ("files",),
)
def ec_roundtrip(s, d):
    """Every distinct text as a stripe, decoded without shards 1 and 3."""
    f = T.files(s, d).filter("size > 0").withColumn("id", F.sha2("content", 256))
    c = f.groupBy("id").agg(F.first("content").alias("data"), F.first("size").alias("size"), F.count(F.lit(1)).alias("copies"))
    back = erasure.decode_chunks(erasure.encode_chunks(c).filter("slot not in (1, 3)"))
    return back.select("id", F.sha2("data", 256).alias("decoded")).join(c.select("id", "copies"), "id").select("id", "copies", "decoded")


@query("SELECT count(DISTINCT content) * 2 AS rebuilt, true AS equal FROM files WHERE size > 0", ("files",))
def ec_rebuild(s, d):
    f = T.files(s, d).filter("size > 0").withColumn("id", F.sha2("content", 256))
    shards = erasure.encode_chunks(f.groupBy("id").agg(F.first("content").alias("data"), F.first("size").alias("size")))
    new = erasure.rebuild_shards(shards.filter("slot not in (0, 5)"))
    both = new.join(shards.select("id", "slot", F.col("shard").alias("was")), ["id", "slot"])
    return both.agg(F.count(F.lit(1)).alias("rebuilt"), F.bool_and(F.col("shard") == F.col("was")).alias("equal"))


# --- sources --------------------------------------------------------------------------------------------


@query(
    """SELECT doc_id, CASE WHEN n >= 1073741824 THEN printf('%.1f GiB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.1f MiB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KiB', n / 1024.0) ELSE printf('%d B', n) END AS human,
        (doc_id % 20) % 3 + 1 AS slot, CAST(CASE WHEN n <= b THEN b WHEN n <= 2 * b THEN 2 * b WHEN n <= 5 * b THEN 5 * b ELSE 10 * b END AS DOUBLE) AS nice
    FROM (SELECT doc_id, 1 + octet_length(encode(coalesce(text, ''))) AS n, pow(10.0, length(CAST(1 + octet_length(encode(coalesce(text, ''))) AS VARCHAR)) - 1) AS b FROM documents)"""
)
def scalar_functions(s, d):
    t = T.read(s, d, "documents").withColumn("n", (1 + F.coalesce(F.octet_length("text"), F.lit(0))).cast("long"))
    return t.select("doc_id", scalars.human_bytes(F.col("n")).alias("human"), scalars.slot(F.col("doc_id") % 20 + 1, 3).alias("slot"), scalars.nice_max(F.col("n").cast("double")).alias("nice"))


@query(
    """, k AS (SELECT DISTINCT ns, sha256(ns) AS hash FROM files) SELECT f.path, f.ns = 'src' || (length(f.path) % 20) AS allowed FROM files f""",
    ("files",),
)
def key_scopes(s, d):
    f = T.files(s, d)
    keys = f.select("ns").distinct().withColumn("hash", F.sha2("ns", 256))
    ask = f.select("path", F.sha2(F.concat(F.lit("src"), (F.octet_length("path") % 20).cast("string")), 256).alias("hash"))
    return stores.allowed(ask, keys).select("path", "allowed")


@query("SELECT name, line FROM (SELECT op AS name, '# TYPE ' || op || ' counter' AS line FROM samples GROUP BY op UNION ALL SELECT op, op || ' ' || count(*) FROM samples GROUP BY op)".replace("SELECT name, line", "SELECT line"), ("samples",))
def metrics_text(s, d):
    m = reports.tally(T.samples(s, d), ["op"]).select(F.col("op").alias("name"), F.lit("counter").alias("kind"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("label_value"), F.col("n").alias("value"))
    return stores.metrics_text(m)

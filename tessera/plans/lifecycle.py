"""Queries of the life cycles, faults and invariants, with their SQL; part of the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import chunks, cluster, repair, reports
from tessera.operators import lifecycle as L
from tessera.plans.catalogue import _COPIES, FACTOR, HOUR, ORACLES, _copies, query
from tessera.sources import tables as T

_SHARDS = "sh AS (SELECT (id - 1) // 6 AS stripe, (id - 1) % 6 AS slot, id FROM chunks)"


def _shards(s, d):
    return T.chunks(s, d).select(F.expr("(id - 1) div 6").alias("stripe"), ((F.col("id") - 1) % 6).alias("slot"), "id")


# --- claims, holds, state -------------------------------------------------------------------------------


@query("SELECT id, count(*) AS claims FROM version_chunks WHERE version % 13 = 0 GROUP BY id", ("version_chunks",))
def claim_counts(s, d):
    return L.claim_counts(T.version_chunks(s, d).filter("version % 13 = 0"))


@query(
    """, a AS (SELECT id, count(*) AS n FROM version_chunks WHERE version % 13 = 0 GROUP BY id), b AS (SELECT id, count(*) AS n FROM version_chunks WHERE version % 13 = 0 AND idx < 3 GROUP BY id)
    SELECT coalesce(a.id, b.id) AS id, coalesce(b.n, 0) AS stored, coalesce(a.n, 0) AS counted FROM a FULL JOIN b ON a.id = b.id WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
    ("version_chunks",),
)
def claim_drift(s, d):
    """A stored counter that missed the claims beyond the third of an upload."""
    v = T.version_chunks(s, d).filter("version % 13 = 0")
    return chunks.drift(L.claim_counts(v.filter("idx < 3")), L.claim_counts(v), "id", "claims")


_HOLDS = ", h AS (SELECT stripe, count(*) AS holds FROM (SELECT id // 6 AS stripe FROM chunks WHERE id % 2 = 0 UNION ALL SELECT id // 6 FROM version_chunks WHERE version % 13 = 0 AND id % 2 = 0) GROUP BY stripe)"


def _holds(s, d):
    of = F.expr("id div 6").alias("stripe")
    return L.stripe_holds(T.chunks(s, d).filter("id % 2 = 0").select(of), T.version_chunks(s, d).filter("version % 13 = 0 and id % 2 = 0").select(of))


@query(f"{_HOLDS} SELECT stripe, holds FROM h", ("chunks", "version_chunks"))
def stripe_holds(s, d):
    return _holds(s, d)


@query(f"{_HOLDS} SELECT stripe, CASE WHEN stripe % 5 = 0 THEN 0 ELSE 3 END AS stored, holds AS counted FROM h WHERE holds <> CASE WHEN stripe % 5 = 0 THEN 0 ELSE 3 END", ("chunks", "version_chunks"))
def stripe_drift(s, d):
    h = _holds(s, d)
    return chunks.drift(h.filter("stripe % 5 <> 0").select("stripe", F.lit(3).cast("long").alias("holds")), h, "stripe", "holds")


@query(
    """, u AS (SELECT ns, CAST(sum(size) AS BIGINT) AS used FROM files GROUP BY ns), p AS (SELECT ns, CAST(sum(size) AS BIGINT) AS used FROM files WHERE size % 3 <> 0 GROUP BY ns)
    SELECT u.ns, coalesce(p.used, 0) AS stored, u.used AS counted FROM u LEFT JOIN p ON u.ns = p.ns WHERE coalesce(p.used, 0) <> u.used""",
    ("files",),
)
def namespace_drift(s, d):
    f = T.files(s, d)
    use = lambda x: x.groupBy("ns").agg(F.sum("size").alias("used"))
    return chunks.drift(use(f.filter("size % 3 <> 0")), use(f), "ns", "used")


_DIGEST = "count(*) AS n, CAST(sum(CAST(CAST('0x' || substr(sha256({}), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest"


@query(f"SELECT ns, {_DIGEST.format('path || chr(10) || size')} FROM files GROUP BY ns", ("files",))
def state_digest(s, d):
    return L.state_digest(T.files(s, d), ["ns"], F.concat("path", F.lit("\n"), F.col("size").cast("string")))


@query(
    f""", r AS (SELECT ns, path, size, unnest([1, 2, 3]) AS peer FROM files), g AS (SELECT ns, peer, {_DIGEST.format("path || chr(10) || CASE WHEN peer = 3 AND size % 500 = 1 THEN 0 ELSE size END")} FROM r GROUP BY ns, peer)
    SELECT ns, count(DISTINCT n || ' ' || digest) = 1 AS agree FROM g GROUP BY ns""",
    ("files",),
)
def states_agree(s, d):
    """Three peers, of which one has other sizes here and there."""
    r = T.files(s, d).select("ns", "path", "size", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("peer"))
    seen = F.when((F.col("peer") == 3) & (F.col("size") % 500 == 1), 0).otherwise(F.col("size"))
    return L.states_agree(L.state_digest(r, ["ns", "peer"], F.concat("path", F.lit("\n"), seen.cast("string"))), ["ns"])


# --- deletes and trims ----------------------------------------------------------------------------------

_GC = """, e AS (SELECT client % 40 AS id, latency_us % 3 AS node, seq AS pos, CASE op WHEN 'signup' THEN 'mark' WHEN 'error' THEN 'unmark' WHEN 'purchase' THEN 'done' ELSE 'intent' END AS kind FROM samples)"""


def _gc(s, d):
    kind = F.when(F.col("op") == "signup", "mark").when(F.col("op") == "error", "unmark").when(F.col("op") == "purchase", "done").otherwise("intent")
    return T.samples(s, d).select((F.col("client") % 40).alias("id"), (F.col("latency_us") % 3).alias("node"), F.col("seq").alias("pos"), kind.alias("kind"))


@query(
    f"""{_GC}, m AS (SELECT *, sum(CASE kind WHEN 'mark' THEN 1 WHEN 'unmark' THEN -1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS marks FROM e),
    o AS (SELECT * FROM m WHERE kind = 'done' OR (kind = 'intent' AND marks <= 0)),
    l AS (SELECT id, node, max(pos) AS ended FROM o WHERE kind = 'done' GROUP BY id, node)
    SELECT o.id, o.node, min(pos) AS pos FROM o LEFT JOIN l ON l.id = o.id AND l.node = o.node WHERE kind = 'intent' AND pos > coalesce(ended, -1) GROUP BY o.id, o.node""",
    ("samples",),
)
def gc_pending(s, d):
    return L.gc_pending(_gc(s, d))


@query(
    """, e AS (SELECT client % 40 AS id, seq AS pos, latency_us % 3 AS node, op IN ('view', 'click', 'signup') AS intent, row_number() OVER (PARTITION BY client % 40 ORDER BY seq) AS n FROM samples),
    r AS (SELECT id, pos, node, intent AS accepted, CASE WHEN intent THEN node END AS holder, n FROM e WHERE n = 1
          UNION ALL SELECT e.id, e.pos, e.node, CASE WHEN intent THEN r.holder IS NULL ELSE coalesce(r.holder = e.node, false) END,
              CASE WHEN intent THEN coalesce(r.holder, e.node) WHEN r.holder = e.node THEN NULL ELSE r.holder END, e.n FROM r JOIN e ON e.id = r.id AND e.n = r.n + 1)
    SELECT id, pos, node, accepted FROM r""",
    ("samples",),
)
def trim_events(s, d):
    kind = F.when(F.col("op").isin("view", "click", "signup"), "intent").otherwise("done")
    return L.trim_events(T.samples(s, d).select((F.col("client") % 40).alias("id"), F.col("seq").alias("pos"), (F.col("latency_us") % 3).alias("node"), kind.alias("kind")))


@query(
    """, p AS (SELECT id, node, CASE WHEN node % 4 = 0 THEN NULL ELSE (id * node) % 5000 END AS sent, (id + node) % 17 = 0 AS acked FROM locations)
    SELECT id, node FROM p JOIN nodes USING (node) WHERE alive AND NOT acked AND (sent IS NULL OR 6000 - sent >= 3000)""",
    ("nodes",),
)
def pending_deletes(s, d):
    p = T.locations(s, d).select("id", "node", F.when(F.col("node") % 4 != 0, (F.col("id") * F.col("node")) % 5000).alias("sent"), ((F.col("id") + F.col("node")) % 17 == 0).alias("acked"))
    return L.pending_deletes(p, T.nodes(s, d), 6000, 3000)


@query("SELECT id, node FROM locations WHERE id % 4 = 0 AND NOT (id % 8 = 0 AND node % 3 <> 0)", ("locations",))
def pruned_orphans(s, d):
    loc = T.locations(s, d)
    return L.pruned(loc.filter("id % 4 = 0"), loc.filter("id % 8 = 0 and node % 3 <> 0"))


@query(
    f""", t AS (SELECT id, node, (id * 7 + node) % 1000 AS decided FROM locations WHERE id % 11 = 0 AND node % 3 = 0 AND id NOT IN (SELECT id FROM locations WHERE (id + node) % 400 = 0)),
    f AS (SELECT node, (node * 37) % 1000 AS "at" FROM nodes WHERE NOT alive)
    SELECT t.id, t.node, decided, count(DISTINCT CASE WHEN n.alive AND l.node <> t.node THEN l.node END) AS intact FROM t LEFT JOIN locations l ON l.id = t.id LEFT JOIN nodes n ON n.node = l.node LEFT JOIN f ON f.node = l.node
    GROUP BY ALL HAVING NOT coalesce(bool_or(decided - "at" <= 200), false) AND intact < {FACTOR}""",
    ("nodes",),
)
def trim_watch(s, d):
    loc, nodes = T.locations(s, d), T.nodes(s, d)
    trims = loc.filter("id % 11 = 0 and node % 3 = 0").withColumn("decided", (F.col("id") * 7 + F.col("node")) % 1000)
    failures = nodes.filter("not alive").select("node", ((F.col("node") * 37) % 1000).alias("at"))
    holders = loc.join(nodes.select("node", F.col("alive").alias("running")), "node")
    return L.trim_violations(trims, holders, failures, loc.filter("(id + node) % 400 = 0"), FACTOR, 200)


# --- timelines ------------------------------------------------------------------------------------------

_LOGS = """, l AS (SELECT CASE WHEN seq % 3 = 0 THEN 'a' ELSE 'b' END AS peer, seq // 2 AS "at", CASE WHEN op IN ('signup', 'error') THEN 'raft' ELSE 'file' END AS kind, client AS node,
        CASE op WHEN 'signup' THEN 'term ' || latency_us % 50 WHEN 'error' THEN 'vote ' || latency_us % 3 ELSE op END AS text FROM samples)"""


@query(
    f"""{_LOGS}, c AS (SELECT max("at") // 2 AS cut FROM l)
    SELECT min("at") AS "at", kind, node, text FROM l WHERE kind = 'raft' GROUP BY kind, node, text, CASE WHEN text LIKE 'term %' THEN NULL ELSE "at" END
    UNION ALL SELECT "at", kind, node, text FROM l, c WHERE kind <> 'raft' AND ((peer = 'a' AND "at" <= cut) OR (peer = 'b' AND "at" > cut))""",
    ("samples",),
)
def merged_timeline(s, d):
    op, us = F.col("op"), F.col("latency_us")
    text = F.when(op == "signup", F.concat(F.lit("term "), (us % 50).cast("string"))).when(op == "error", F.concat(F.lit("vote "), (us % 3).cast("string"))).otherwise(op)
    logs = T.samples(s, d).select(
        F.when(F.col("seq") % 3 == 0, "a").otherwise("b").alias("peer"), F.expr("seq div 2").alias("at"), F.when(op.isin("signup", "error"), "raft").otherwise("file").alias("kind"), F.col("client").alias("node"), text.alias("text")
    )
    cut = (logs.agg(F.max("at")).first()[0] or 0) // 2
    return L.merge_events(logs, cut, "a", "b")


@query(
    f""", s AS (SELECT node, seq, t, lead(t, 8) OVER (PARTITION BY node ORDER BY t, seq) AS gone FROM heartbeats)
    SELECT node, seq, (seq % 120) * {HOUR} AS rtt FROM s WHERE seq % 3 <> 0 AND (gone IS NULL OR gone > t + (seq % 120) * {HOUR})""",
    ("heartbeats",),
)
def ack_times(s, d):
    b = T.heartbeats(s, d).select("node", "seq", "t")
    return L.ack_times(b, b.filter("seq % 3 <> 0").select("node", "seq", (F.col("t") + (F.col("seq") % 120) * HOUR).alias("at")))


@query(
    """, p AS (SELECT client AS node, seq, t, CASE WHEN op = 'purchase' THEN latency_us END AS put FROM samples),
    r AS (SELECT *, count(put) OVER w AS run, coalesce(last_value(put IGNORE NULLS) OVER w, 0) AS l FROM p WINDOW w AS (PARTITION BY node ORDER BY t, seq ROWS UNBOUNDED PRECEDING)),
    k AS (SELECT *, greatest(row_number() OVER (PARTITION BY node, run ORDER BY t, seq) - CASE WHEN run > 0 THEN 1 ELSE 0 END - 3, 0) AS h FROM r)
    SELECT node, seq, CAST(CASE WHEN h > 0 AND l // CAST(pow(2, least(h, 40)) AS BIGINT) < 1000 THEN 0 ELSE l // CAST(pow(2, least(h, 40)) AS BIGINT) END AS BIGINT) AS put FROM k""",
    ("samples",),
)
def idle_decay(s, d):
    return L.idle_decay(T.samples(s, d).select(F.col("client").alias("node"), "seq", "t", F.when(F.col("op") == "purchase", F.col("latency_us")).alias("put_us")))


# --- repair ---------------------------------------------------------------------------------------------


@query(
    f"""{_COPIES}, {_SHARDS}, j AS (SELECT stripe, slot, id, alive, readable, sum(least(readable, 1)) OVER (PARTITION BY stripe) - least(readable, 1) AS siblings FROM sh JOIN copies USING (id))
    SELECT stripe, slot, id, CAST(CASE WHEN readable = 0 THEN siblings - 3 ELSE alive END AS BIGINT) AS rank FROM j WHERE alive = 0""",
    ("nodes",),
)
def rebuild_ranks(s, d):
    return L.rebuild_ranks(_shards(s, d), _copies(s, d))


@query(
    f""", {_SHARDS}, r AS (SELECT id, node, NOT alive AS suspect, row_number() OVER (PARTITION BY id ORDER BY NOT alive, slow, node) - 1 AS nth FROM locations JOIN nodes USING (node))
    SELECT stripe, row_number() OVER (PARTITION BY stripe ORDER BY CASE WHEN nth > 0 THEN 2 WHEN suspect THEN 1 ELSE 0 END, slot, nth) AS place, slot, node FROM sh JOIN r USING (id)""",
    ("nodes",),
)
def shard_order(s, d):
    r = T.locations(s, d).join(T.nodes(s, d).select("node", (~F.col("alive")).alias("suspect"), "slow"), "node")
    return L.shard_order(_shards(s, d), r)


_TURN = 'h AS (SELECT node, id, count(*) OVER (PARTITION BY node) AS n, row_number() OVER (PARTITION BY node ORDER BY id) - 1 AS "at" FROM locations), u AS (SELECT *, ("at" - (node * 31) % n + n) % n AS turn FROM h)'


@query(f''', {_TURN} SELECT node, id FROM u WHERE turn < 5''', ("locations",))
def rot_picker(s, d):
    return L.rot_pick(T.locations(s, d), 5, F.col("node") * 31)


@query(
    f''', {_TURN}, k AS (SELECT id, count(*) AS intact FROM locations WHERE node % 5 <> 0 GROUP BY id) SELECT node, id FROM u LEFT JOIN k USING (id) WHERE coalesce(intact, 0) >= 2 QUALIFY row_number() OVER (PARTITION BY node ORDER BY turn) <= 5''',
    ("locations",),
)
def rot_with_survivors(s, d):
    """Only chunks with two copies or more on nodes that were never wiped."""
    loc = T.locations(s, d)
    k = loc.filter("node % 5 <> 0").groupBy("id").agg(F.count(F.lit(1)).alias("intact"))
    return L.rot_pick(loc.join(k, "id", "left"), 5, F.col("node") * 31, F.coalesce("intact", F.lit(0)) >= 2)


@query(
    f""", g AS (SELECT id, node FROM locations WHERE (id + node) % 60 = 0), b AS (SELECT l.id, count_if(n.alive) AS rank, count(*) AS readable FROM locations l JOIN nodes n USING (node)
        WHERE l.id IN (SELECT id FROM g) AND NOT EXISTS (FROM g WHERE g.id = l.id AND g.node = l.node) GROUP BY l.id)
    SELECT id, rank FROM b WHERE id % 3 <> 0 AND rank < {FACTOR}""",
    ("nodes",),
)
def repair_recheck(s, d):
    loc = T.locations(s, d)
    removed = loc.filter("(id + node) % 60 = 0").unionAll(loc.select("id", (F.col("node") + 1_000_000).alias("node")))  # reported, never there
    wanted = T.chunks(s, d).filter("id % 3 <> 0").select("id", F.lit(FACTOR).alias("target"))
    return L.recheck(removed, loc, T.nodes(s, d), wanted)


_ASSESSED = f"a AS (SELECT CAST(CASE WHEN alive = 0 THEN 0 ELSE 1 END AS BIGINT) AS class, alive AS rank, id FROM copies WHERE alive < {FACTOR} AND readable > 0 AND id % 7 <> 0)"


@query(
    f"""{_COPIES}, {_ASSESSED}, q AS (SELECT CAST(CASE WHEN alive = 0 THEN 0 ELSE 1 END AS BIGINT) AS class, alive + id % 2 AS rank, id, id % 5 = 0 AS move FROM copies WHERE alive < {FACTOR} AND readable > 0 AND id % 3 <> 0)
    SELECT coalesce(a.id, q.id) AS id, CASE WHEN a.id IS NULL THEN 'cancel' WHEN q.id IS NULL THEN 'insert' WHEN a.class = q.class AND a.rank = q.rank THEN 'keep' ELSE 'rekey' END AS action,
        coalesce(a.class, q.class) AS class, coalesce(a.rank, q.rank) AS rank, CASE WHEN a.class = q.class AND a.rank = q.rank THEN q.move END AS move FROM a FULL JOIN q ON a.id = q.id""",
    ("nodes",),
)
def queue_changes(s, d):
    now = repair.repair_queue(_copies(s, d), FACTOR).select("id", "class", "rank")
    old = now.filter("id % 3 <> 0").select("id", "class", (F.col("rank") + F.col("id") % 2).alias("rank"), (F.col("id") % 5 == 0).alias("move"))
    return L.queue_changes(old, now.filter("id % 7 <> 0"))


@query(
    f""", m AS (SELECT id, node AS source, (id * 13 + node) % 100 + 1 AS target FROM locations),
    g AS (SELECT id, count(*) AS n, count_if(alive) AS sure, list(node) FILTER (alive) AS live, list(node) AS every, list(rack) FILTER (alive) AS racks FROM locations JOIN nodes USING (node) GROUP BY id),
    x AS (SELECT m.*, g.*, t.alive AND t.admin = 'active' AS fit, o.rack AS own, m.source % 17 = 0 OR m.target % 17 = 0 AS busy FROM m JOIN g USING (id) LEFT JOIN nodes t ON t.node = m.target JOIN nodes o ON o.node = m.source)
    SELECT id, source, target, CASE WHEN NOT coalesce(id % 11 <> 0 AND n = {FACTOR} AND sure = {FACTOR} AND list_contains(live, source) AND NOT list_contains(every, target) AND fit, false) THEN 'dropped' WHEN busy THEN 'blocked' ELSE 'started' END AS verdict,
        coalesce(list_contains(live, source) AND (len(list_filter(racks, lambda r: r = own)) > 1 OR len(list_distinct(racks)) = len(racks)), false) AS spread FROM x""",
    ("nodes",),
)
def move_checks(s, d):
    loc, nodes = T.locations(s, d), T.nodes(s, d)
    moves = loc.select("id", F.col("node").alias("source"), ((F.col("id") * 13 + F.col("node")) % 100 + 1).alias("target"))
    busy = nodes.filter("node % 17 = 0").select("node", F.lit(2).alias("n"))
    return L.check_moves(moves, loc, nodes, busy, T.chunks(s, d).filter("id % 11 = 0"), FACTOR, 2)


_MEMBERS = ", st AS (SELECT node, rack, CASE WHEN alive AND admin = 'active' THEN 'eligible' WHEN NOT alive THEN 'gone' ELSE 'unsettled' END AS state FROM nodes), tr AS (SELECT id, node FROM locations WHERE id % 11 = 0 AND node % 3 = 0), fl AS (SELECT id, (id * 13) % 100 + 1 AS target FROM chunks WHERE id % 19 = 0), cp AS (SELECT l.id, l.node, size FROM locations l JOIN chunks USING (id) JOIN st USING (node) WHERE state = 'eligible' AND NOT EXISTS (FROM tr WHERE tr.id = l.id AND tr.node = l.node))"


def _balance(s, d):
    loc, n = T.locations(s, d), T.nodes(s, d)
    state = F.when(F.col("alive") & (F.col("admin") == "active"), "eligible").when(~F.col("alive"), "gone").otherwise("unsettled")
    coming = T.chunks(s, d).filter("id % 19 = 0").select("id", ((F.col("id") * 13) % 100 + 1).alias("target"))
    return L.balance_input(n.select("node", "rack", state.alias("state")), loc, T.chunks(s, d), loc.filter("id % 11 = 0 and node % 3 = 0"), coming, FACTOR)


@query(
    f"""{_MEMBERS}, u AS (SELECT node, sum(size) AS used FROM (SELECT node, size FROM cp UNION ALL SELECT target, size FROM fl JOIN chunks USING (id)) GROUP BY node)
    SELECT node, rack, CAST(coalesce(used, 0) AS BIGINT) AS used, (SELECT count_if(state = 'unsettled') = 0 FROM st) AS settled FROM st LEFT JOIN u USING (node) WHERE state = 'eligible'""",
    ("nodes",),
)
def balance_loads(s, d):
    return _balance(s, d)[0]


@query(
    f"""{_MEMBERS} SELECT c.id, c.size, count(cp.node) AS n, c.id IN (SELECT id FROM tr) OR c.id IN (SELECT id FROM fl) OR count(cp.node) <> {FACTOR} OR (SELECT count(*) FROM locations l WHERE l.id = c.id) <> {FACTOR} AS pinned
    FROM chunks c LEFT JOIN cp ON cp.id = c.id GROUP BY c.id, c.size""",
    ("nodes",),
)
def balance_chunks(s, d):
    return _balance(s, d)[1]


@query(
    """, st AS (SELECT DISTINCT chunk AS id, node AS target, seq AS "at" FROM reports WHERE seq % 7 = 0)
    SELECT id, target, "at", CASE WHEN min(r.seq) IS NULL THEN 'timeout' ELSE 'done' END AS state, coalesce(min(r.seq), "at" + 2000) AS ended FROM st LEFT JOIN reports r ON r.chunk = st.id AND r.node = st.target AND r.seq > "at" AND r.seq <= "at" + 2000 GROUP BY id, target, "at" """,
    ("reports",),
)
def copy_completion(s, d):
    r = T.reports(s, d)
    return L.copy_ends(r.filter("seq % 7 = 0").select(F.col("chunk").alias("id"), F.col("node").alias("target"), F.col("seq").alias("at")), r.withColumnRenamed("seq", "t"), 2000)


@query(
    f""", h AS (SELECT l.id, l.node, n.rack, n.used, count(*) OVER (PARTITION BY l.id) AS copies, count(*) OVER (PARTITION BY l.id, n.rack) AS on_rack FROM locations l JOIN nodes n USING (node) WHERE n.alive),
    v AS (SELECT id, node AS victim FROM h WHERE copies > {FACTOR} QUALIFY row_number() OVER (PARTITION BY id ORDER BY on_rack DESC, used DESC, node DESC) = 1),
    b AS (SELECT id, min(node) AS node FROM locations WHERE id % 2 = 0 GROUP BY id)
    SELECT id, CASE WHEN EXISTS (FROM h WHERE h.id = b.id AND h.node = b.node) THEN b.node ELSE victim END AS victim FROM b JOIN v USING (id)""",
    ("nodes",),
)
def trim_retries(s, d):
    loc, nodes = T.locations(s, d), T.nodes(s, d)
    before = loc.filter("id % 2 = 0").groupBy("id").agg(F.min("node").alias("node"))
    return L.trim_retries(before, loc.join(nodes.filter("alive").select("node"), "node"), repair.trim_victims(loc, nodes, FACTOR))


@query(f"{_COPIES} SELECT id, greatest(id * 10, 4000 + 500) AS ready FROM copies WHERE alive < {FACTOR}", ("nodes",))
def leader_grace(s, d):
    return L.after_election(_copies(s, d).filter(F.col("alive") < FACTOR).select("id", (F.col("id") * 10).alias("ready")), 4000, 500)


_STATES = ", e AS (SELECT client % 40 AS id, seq AS t, latency_us % 5 AS have, CASE WHEN op = 'error' THEN 1 ELSE 0 END AS lost FROM samples)"


@query(
    f"""{_STATES}, g AS (SELECT *, sum((have >= 3)::INT) OVER (PARTITION BY id ORDER BY t) AS run FROM e),
    f AS (SELECT *, 2 - sum(CASE WHEN have >= 3 THEN 0 ELSE lost END) OVER (PARTITION BY id, run ORDER BY t) AS floor FROM g)
    SELECT id, min(t) AS t, arg_min(have, t) AS have, CAST(arg_min(floor, t) AS BIGINT) AS floor FROM f WHERE have < 3 AND have < floor GROUP BY id""",
    ("samples",),
)
def floor_breaches(s, d):
    lost = F.when(F.col("op") == "error", 1).otherwise(0)
    return L.floor_breaches(T.samples(s, d).select((F.col("client") % 40).alias("id"), F.col("seq").alias("t"), (F.col("latency_us") % 5).alias("have"), lost.alias("lost")), 3, 2)


@query(
    "SELECT n.node, node % 4 >= node % 3 + 2 AS settled, (SELECT count(*) FROM locations l WHERE l.node = n.node AND (l.id + l.node) % 50 = 0) AS corrupt FROM nodes n WHERE alive",
    ("nodes",),
)
def scrubbed_nodes(s, d):
    n = T.nodes(s, d).filter("alive").select("node", (F.col("node") % 3).alias("start"), (F.col("node") % 4).alias("passes"))
    return L.scrubbed(n, T.locations(s, d).filter("(id + node) % 50 = 0"))


# --- faults, administration, output ---------------------------------------------------------------------

_FAULTS = ', f AS (SELECT client % 10 AS node, seq, seq AS "at", seq + latency_us % 300 AS until FROM samples)'


def _faults(s, d):
    return T.samples(s, d).select((F.col("client") % 10).alias("node"), "seq", F.col("seq").alias("at"), (F.col("seq") + F.col("latency_us") % 300).alias("until"))


@query(f'''{_FAULTS} SELECT node, "at", until FROM f QUALIFY "at" < max(until) OVER (PARTITION BY node ORDER BY "at", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)''', ("samples",))
def fault_overlaps(s, d):
    return L.fault_overlaps(_faults(s, d))


@query(
    f"""{_FAULTS}, e AS (SELECT node, "at" AS tm, 1 AS x FROM f UNION ALL SELECT node, until, -1 FROM f), g AS (SELECT node, tm, x, sum(x) AS ds FROM e GROUP BY ALL)
    SELECT node, CAST(max(l) AS BIGINT) AS peak, max(l) > 2 AS refused FROM (SELECT node, sum(ds) OVER (PARTITION BY node ORDER BY tm, x ROWS UNBOUNDED PRECEDING) AS l FROM g) GROUP BY node""",
    ("samples",),
)
def faults_at_once(s, d):
    """How many faults of a node run at once, and whether that breaks the rule of two."""
    return reports.peak_in_flight(_faults(s, d).select("node", F.col("at").alias("start"), F.col("until").alias("end")), ["node"]).withColumn("refused", F.col("peak") > 2)


@query(
    f""", c AS (SELECT node, sum(size) AS bytes FROM locations JOIN chunks USING (id) GROUP BY node)
    SELECT node, CAST(8 + 30 + 2 * 10 + 5 + bytes / 100.0 AS DOUBLE) AS bound, CAST(node AS DOUBLE) <= 8 + 30 + 2 * 10 + 5 + bytes / 100.0 AS held FROM c""",
    ("chunks", "locations"),
)
def restored_in_time(s, d):
    use = cluster.node_usage(T.locations(s, d), T.chunks(s, d)).select("node", scalars.repair_bound(8, 30, F.col("bytes"), 100, 10).alias("bound"))
    return use.withColumn("held", F.col("node").cast("double") <= F.col("bound"))


@query("SELECT client % 5 AS link, CASE op WHEN 'error' THEN 'dropped' WHEN 'signup' THEN 'duplicated' ELSE 'delivered' END AS outcome, count(*) AS n, CAST(sum(latency_us) AS BIGINT) AS bytes FROM samples GROUP BY 1, 2", ("samples",))
def network_counters(s, d):
    outcome = F.when(F.col("op") == "error", "dropped").when(F.col("op") == "signup", "duplicated").otherwise("delivered")
    return T.samples(s, d).groupBy((F.col("client") % 5).alias("link"), outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum("latency_us").alias("bytes"))


@query(
    """, e AS (SELECT client AS node, seq AS pos, CASE op WHEN 'view' THEN 'draining' WHEN 'click' THEN 'draining' WHEN 'error' THEN 'active' ELSE 'decommissioned' END AS wanted, row_number() OVER (PARTITION BY client ORDER BY seq) AS n FROM samples),
    r AS (SELECT node, pos, wanted, wanted <> 'decommissioned' AS accepted, CASE WHEN wanted = 'decommissioned' THEN 'active' ELSE wanted END AS now, n FROM e WHERE n = 1
          UNION ALL SELECT e.node, e.pos, e.wanted, NOT ((e.wanted = 'decommissioned' AND now = 'active') OR (e.wanted = 'draining' AND now = 'decommissioned')),
              CASE WHEN (e.wanted = 'decommissioned' AND now = 'active') OR (e.wanted = 'draining' AND now = 'decommissioned') THEN now ELSE e.wanted END, e.n FROM r JOIN e ON e.node = r.node AND e.n = r.n + 1)
    SELECT node, pos, wanted, accepted FROM r""",
    ("samples",),
)
def admin_log(s, d):
    wanted = F.when(F.col("op").isin("view", "click"), "draining").when(F.col("op") == "error", "active").otherwise("decommissioned")
    return L.admin_log(T.samples(s, d).select(F.col("client").alias("node"), F.col("seq").alias("pos"), wanted.alias("wanted")))


@query("SELECT client, seq, first_value(latency_us) OVER w AS answer, row_number() OVER w > 1 AS retry FROM (SELECT *, latency_us % 9 AS request FROM samples) WINDOW w AS (PARTITION BY client, request ORDER BY seq)", ("samples",))
def retry_answers(s, d):
    return L.answers(T.samples(s, d).withColumn("request", F.col("latency_us") % 9), ["client", "request"], "seq", "latency_us").select("client", "seq", "answer", "retry")


@query(
    """, p AS (SELECT node AS peer, CASE WHEN node = 3 THEN 'leader' ELSE 'follower' END AS role, used AS matched FROM nodes WHERE node <= 7)
    SELECT 3 AS asked, peer, role, matched FROM p UNION ALL SELECT peer, peer, role, matched FROM p WHERE role <> 'leader'""",
    ("nodes",),
)
def peers_view(s, d):
    n = T.nodes(s, d).filter("node <= 7")
    return L.peers_view(n.select(F.col("node").alias("peer"), F.when(F.col("node") == 3, "leader").otherwise("follower").alias("role"), F.col("used").alias("matched")))


@query("SELECT path, hash FROM (SELECT path, sha256(CASE WHEN size % 7 = 0 THEN path ELSE content END) AS hash, sha256(content) AS was FROM files) WHERE hash <> was", ("files",))
def unwritten_reads(s, d):
    f = T.files(s, d).select("path", "size", F.hex("content").alias("content"))
    reads = f.select("path", F.sha2(F.when(F.col("size") % 7 == 0, F.col("path")).otherwise(F.col("content")), 256).alias("hash"))
    return L.unwritten_reads(reads, f.select("path", F.sha2("content", 256).alias("hash")))


@query(
    f"""{_COPIES}, d AS (SELECT path, v, tombstone, row_number() OVER (PARTITION BY path ORDER BY v) AS n FROM versions)
    SELECT 'chunk_lost' AS invariant, count_if(readable = 0) AS violations FROM copies UNION ALL SELECT 'chunk_under', count_if(alive < {FACTOR}) FROM copies
    UNION ALL SELECT 'copy_of_nothing', count(*) FROM locations WHERE id NOT IN (SELECT id FROM version_chunks)
    UNION ALL SELECT 'copy_twice', (SELECT count(*) FROM locations) - (SELECT count(*) FROM (SELECT DISTINCT id, node FROM locations))
    UNION ALL SELECT 'stripe_lost', count(*) FROM (SELECT (id - 1) // 6 AS stripe FROM copies GROUP BY 1 HAVING count(*) = 6 AND sum(least(readable, 1)) < 4) UNION ALL SELECT 'version_gap', count_if(v <> n) FROM d""",
    ("nodes", "version_chunks", "versions"),
)
def invariant_suite(s, d):
    c, loc, shards = _copies(s, d), T.locations(s, d), _shards(s, d)
    whole = shards.groupBy("stripe").count().filter("count = 6").select("stripe")
    v = T.versions(s, d).withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("v")))
    return L.invariants(
        {
            "chunk_lost": c.filter("readable = 0"),
            "chunk_under": c.filter(F.col("alive") < FACTOR),
            "copy_of_nothing": loc.join(T.version_chunks(s, d).select("id").distinct(), "id", "left_anti"),
            "copy_twice": loc.groupBy("id", "node").count().filter("count > 1"),
            "stripe_lost": cluster.stripe_health(shards.join(whole, "stripe"), c).filter("state = 'lost'"),
            "version_gap": v.filter("v <> n"),
        }
    )


@query("SELECT rack, CAST(node AS VARCHAR) AS id, 'host' || node AS host, CAST(7000 + node AS INTEGER) AS port FROM nodes", ("nodes",))
def peer_lists(s, d):
    """The peers of a rack as one argument, and what is read back from it."""
    entry = F.concat(F.col("node").cast("string"), F.lit("=host"), F.col("node").cast("string"), F.lit(":"), (F.col("node") + 7000).cast("string"))
    text = T.nodes(s, d).groupBy("rack").agg(F.concat_ws(",", F.collect_list(entry), F.lit("=x:1"), F.lit("y=z")).alias("text"))
    return text.select("rack", F.explode(scalars.peer_list(F.col("text"))).alias("x")).select("rack", "x.id", "x.host", "x.port")


@query("SELECT path, CAST('0x' || substr(md5('7:' || path), 1, 8) AS BIGINT) < 429496729 AS drawn FROM files", ("files",))
def seeded_chance(s, d):
    return T.files(s, d).select("path", scalars.chance(7, F.col("path"), 0.1).alias("drawn"))


@query("SELECT path, sha256(coalesce((SELECT string_agg(sha256('5:' || path || ':' || i), '' ORDER BY i) FROM range(1, size % 4 + 1) r(i)), '')) AS hash, 64 * (size % 4) AS bytes FROM files", ("files",))
def generated_files(s, d):
    g = T.files(s, d).withColumn("data", scalars.generated(5, F.col("path"), (F.col("size") % 4).cast("int")))
    return g.select("path", F.sha2("data", 256).alias("hash"), F.length("data").cast("long").alias("bytes"))


@query("SELECT path, path || chr(9) || v || chr(9) || size AS line, '| ' || path || ' | ' || v || ' |' AS row FROM versions", ("versions",))
def rendered_lines(s, d):
    v = T.versions(s, d)
    return v.select("path", scalars.table_line(F.col("path"), F.col("v"), F.col("size")).alias("line"), scalars.markdown_row(F.col("path"), F.col("v")).alias("row"))


@query(
    """, c AS (SELECT path, tombstone, count(*) AS n, sum(size) AS size FROM versions GROUP BY path, tombstone), l AS (SELECT path, list(tombstone ORDER BY tombstone) AS kinds, max(CASE WHEN tombstone THEN n END) AS deletes, count_if(size > 10000000) AS large FROM c GROUP BY path)
    SELECT path, len(kinds) AS kinds, deletes, large FROM l""",
    ("versions",),
)
def map_functions(s, d):
    """Lookup, sorted keys and filter of a map for each path."""
    c = T.versions(s, d).groupBy("path", "tombstone").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    m = c.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("tombstone", F.struct("n", "size")))).alias("m"))  # two entries a path
    return m.select(
        "path", F.size(F.array_sort(F.map_keys("m"))).cast("long").alias("kinds"), F.try_element_at("m", F.lit(True))["n"].alias("deletes"), F.size(F.map_filter("m", lambda _, x: x["size"] > 10_000_000)).cast("long").alias("large")
    )


@query("SELECT DISTINCT ns, sha256('secret of ' || ns) AS hash FROM files", ("files",))
def key_records(s, d):
    return T.files(s, d).select("ns").distinct().select("ns", scalars.key_record(F.concat(F.lit("secret of "), "ns")).alias("hash"))


@query()
def record_checksums(s, d):
    """CRC-32C of every file's bytes; DuckDB has no such function."""
    return T.files(s, d).select("path", scalars.crc32c(F.col("content")).alias("crc"))


for _name in ("trim_events", "admin_log"):
    ORACLES[_name] = ORACLES[_name].replace("WITH ", "WITH RECURSIVE ", 1)

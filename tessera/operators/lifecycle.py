"""Life cycles around the replicas: claims and holds, deletes and trims in the log, the repair queue, moves, faults and invariants.

All are set operations on whole tables; what needs the order of events is a window
over the events of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DATA_SHARDS, TOTAL_SHARDS = 4, 6


def _so_far(keys: list[str], *order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


# --- claims, holds, state -------------------------------------------------------------------------------


def claim_counts(claims: DataFrame) -> DataFrame:
    """(id, claims): pending claims of each chunk."""
    return claims.groupBy("id").agg(F.count(F.lit(1)).alias("claims"))


def stripe_holds(records: DataFrame, claims: DataFrame) -> DataFrame:
    """(stripe, holds): chunk records and pending claims that name a stripe."""
    return records.select("stripe").unionAll(claims.select("stripe")).groupBy("stripe").agg(F.count(F.lit(1)).alias("holds"))


def state_digest(rows: DataFrame, keys: list[str], line: Column) -> DataFrame:
    """(keys, n, digest): a digest of a set of lines that does not depend on their order: the sum of 60 bits of each line's SHA-256.

    Sums combine before the shuffle, so a state of any size costs one row a task.
    """
    part = F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(part).cast("string").alias("digest"))


def states_agree(digests: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, agree): whether all replicas of a state have one digest."""
    return digests.groupBy(*keys).agg((F.count_distinct("digest", "n") == 1).alias("agree"))


# --- deletes and trims in the log -----------------------------------------------------------------------


def gc_pending(events: DataFrame) -> DataFrame:
    """(id, node, pos): deletes that wait for their answer.

    ``events``: (id, node, pos, kind) in log order; kinds mark, unmark, intent, done.  An
    intent adds its copy unless the chunk is marked at that position or the copy is
    pending already; done removes it.
    """
    marks = F.sum(F.when(F.col("kind") == "mark", 1).when(F.col("kind") == "unmark", -1).otherwise(0)).over(_so_far(["id"], "pos"))
    own = events.withColumn("marks", marks).filter("kind = 'done' or (kind = 'intent' and marks <= 0)")
    done = own.withColumn("ended", F.max(F.when(F.col("kind") == "done", F.col("pos"))).over(Window.partitionBy("id", "node")))
    return done.filter("kind = 'intent' and (ended is null or pos > ended)").groupBy("id", "node").agg(F.min("pos").alias("pos"))


def trim_events(events: DataFrame) -> DataFrame:
    """(id, pos, node, accepted): an intent is accepted if the chunk has none pending, done if it names the pending node.

    ``events``: (id, pos, node, kind).  The pending node is folded over the events of a chunk as a struct
    inside one aggregate expression, in the JVM.
    """
    e = F.array_sort(F.collect_list(F.struct("pos", "node", "kind")))  # the trims of one chunk
    start = F.struct(F.lit(None).cast("long").alias("holder"), F.array().cast("array<struct<pos:bigint,node:bigint,accepted:boolean>>").alias("out"))

    def step(state, x):
        intent, free = x["kind"] == "intent", state["holder"].isNull()
        ok = F.when(intent, free).otherwise(F.coalesce(state["holder"] == x["node"], F.lit(False)))
        holder = F.when(ok & intent, x["node"]).when(ok, F.lit(None).cast("long")).otherwise(state["holder"])
        row = F.struct(x["pos"].cast("long").alias("pos"), x["node"].cast("long").alias("node"), ok.alias("accepted"))
        return F.struct(holder.alias("holder"), F.concat(state["out"], F.array(row)).alias("out"))

    folded = events.groupBy("id").agg(e.alias("e")).select("id", F.aggregate("e", start, step, lambda s: s["out"]).alias("out"))
    return folded.select("id", F.explode("out").alias("x")).select("id", "x.pos", "x.node", "x.accepted")


def pending_deletes(pending: DataFrame, nodes: DataFrame, now: int, epoch: int) -> DataFrame:
    """(id, node) of pending deletes (id, node, sent, acked) to send: never sent, or an epoch ago, to live nodes that did not answer."""
    due = pending.filter(~F.col("acked") & (F.col("sent").isNull() | (F.lit(now) - F.col("sent") >= epoch)))
    return due.join(nodes.filter("alive").select("node"), "node", "left_semi").select("id", "node")


def pruned(known: DataFrame, still: DataFrame) -> DataFrame:
    """Entries of ``known`` (id, node) that are not in ``still``."""
    return known.select("id", "node").join(still.select("id", "node"), ["id", "node"], "left_anti")


def trim_violations(trims: DataFrame, holders: DataFrame, failures: DataFrame, rotted: DataFrame, factor: int, grace: int) -> DataFrame:
    """(id, node, decided, intact) of trims that left fewer than ``factor`` intact copies on running nodes.

    Chunks with a rotted copy are exempt, and those one of whose holders (id, node, running) failed later than ``grace`` before the decision.
    """
    t = trims.join(rotted.select("id").distinct(), "id", "left_anti")
    h = holders.join(failures, "node", "left").select("id", F.col("node").alias("holder"), "running", "at")
    g = t.join(h, "id", "left").groupBy("id", "node", "decided").agg(
        F.coalesce(F.bool_or(F.col("decided") - F.col("at") <= grace), F.lit(False)).alias("recent"), F.count_distinct(F.when(F.col("running") & (F.col("holder") != F.col("node")), F.col("holder"))).alias("intact")
    )
    return g.filter(~F.col("recent") & (F.col("intact") < factor)).select("id", "node", "decided", "intact")


# --- timelines ------------------------------------------------------------------------------------------


def merge_events(logs: DataFrame, switch: int, old: str, new: str) -> DataFrame:
    """(at, kind, node, text): one timeline of the peers' logs (peer, at, kind, node, text).

    Consensus events are logged by several peers: a change of term counts once, others
    once a time.  Other events are the leader's: the old one's up to the switch, then the new one's.
    """
    term = F.col("text").startswith("term ")
    raft = logs.filter("kind = 'raft'").groupBy("node", "text", F.when(~term, F.col("at")).alias("when")).agg(F.min("at").alias("at")).select("at", F.lit("raft").alias("kind"), "node", "text")
    rest = logs.filter(F.col("kind") != "raft").filter(((F.col("peer") == old) & (F.col("at") <= switch)) | ((F.col("peer") == new) & (F.col("at") > switch)))
    return raft.unionByName(rest.select("at", "kind", "node", "text"))


def ack_times(beats: DataFrame, acks: DataFrame, ring: int = 8) -> DataFrame:
    """(node, seq, rtt) of acks (node, seq, at) whose beat (node, seq, t) is still among the last ``ring`` sent."""
    sent = beats.withColumn("gone", F.lead("t", ring).over(Window.partitionBy("node").orderBy("t", "seq")))
    return acks.join(sent, ["node", "seq"]).filter("gone is null or gone > at").select("node", "seq", (F.col("at") - F.col("t")).alias("rtt"))


def idle_decay(beats: DataFrame, idle: int = 3, least: int = 1000) -> DataFrame:
    """(node, seq, put): the last write latency (null: no write since the last beat), halved by each beat beyond ``idle`` without one, 0 below ``least``."""
    w = _so_far(["node"], "t", "seq")
    b = beats.withColumn("run", F.count("put_us").over(w))
    b = b.withColumn("quiet", F.row_number().over(Window.partitionBy("node", "run").orderBy("t", "seq")) - F.when(F.col("run") > 0, 1).otherwise(0))
    halvings = F.greatest(F.col("quiet") - idle, F.lit(0)).cast("int")
    last = F.coalesce(F.last("put_us", ignorenulls=True).over(w), F.lit(0)).cast("long")
    value = F.expr("last div cast(pow(2, least(halvings, 40)) as bigint)")
    b = b.withColumn("last", last).withColumn("halvings", halvings).withColumn("v", value)
    return b.select("node", "seq", F.when((F.col("halvings") > 0) & (F.col("v") < least), 0).otherwise(F.col("v")).cast("long").alias("put"))


# --- repair ---------------------------------------------------------------------------------------------


def rebuild_ranks(shards: DataFrame, copies: DataFrame) -> DataFrame:
    """(stripe, slot, id, rank) of shards without a live copy: readable siblings less the data shards plus one if none can be read, else its live copies."""
    s = shards.join(copies.select("id", "alive", "readable"), "id")
    n = F.sum(F.least("readable", F.lit(1))).over(Window.partitionBy("stripe")) - F.least("readable", F.lit(1))
    return s.withColumn("siblings", n).filter("alive = 0").select("stripe", "slot", "id", F.when(F.col("readable") == 0, F.col("siblings") - DATA_SHARDS + 1).otherwise(F.col("alive")).cast("long").alias("rank"))


def shard_order(shards: DataFrame, replicas: DataFrame) -> DataFrame:
    """(stripe, place, slot, node): in which order the replicas of a stripe's shards are asked.

    The first replica of each shard comes before those that only a suspect node
    has, a shard's other replicas last; lower slots first.  ``replicas``: (id, node, suspect, slow).
    """
    r = replicas.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("suspect", "slow", "node")) - 1)
    rank = F.when(F.col("nth") > 0, 2).when(F.col("suspect"), 1).otherwise(0)
    place = F.row_number().over(Window.partitionBy("stripe").orderBy("rank", "slot", "nth")).cast("long")
    return shards.join(r, "id").withColumn("rank", rank).withColumn("place", place).select("stripe", "place", "slot", "node")


def rot_pick(held: DataFrame, take: int, pick: Column, ok: Column | None = None) -> DataFrame:
    """(node, id): of each node's chunks in order of id, ``take`` from place ``pick`` modulo their number on, wrapping; only those that are ``ok``."""
    w = Window.partitionBy("node")
    n = F.count(F.lit(1)).over(w)
    h = held.withColumn("n", n).withColumn("at", F.row_number().over(w.orderBy("id")) - 1)
    h = h.withColumn("turn", F.pmod(F.col("at") - F.pmod(pick, F.col("n")), F.col("n")))
    h = h if ok is None else h.filter(ok)
    return h.withColumn("nth", F.row_number().over(w.orderBy("turn"))).filter(F.col("nth") <= take).select("node", "id")


def recheck(removed: DataFrame, locations: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, rank) of wanted chunks (id, target) that need a copy once the removed copies (id, node) are gone; lost ones are left out."""
    gone = removed.join(locations, ["id", "node"], "left_semi")
    left = locations.join(gone.select("id").distinct(), "id", "left_semi").join(gone, ["id", "node"], "left_anti").join(nodes.select("node", "alive"), "node")
    have = left.groupBy("id").agg(F.count_if("alive").alias("rank"), F.count(F.lit(1)).alias("readable"))
    return wanted.join(have, "id").filter("rank < target and readable > 0").select("id", "rank")


def queue_changes(queue: DataFrame, assessed: DataFrame) -> DataFrame:
    """(id, action, class, rank, move): a queue (id, class, rank, move) against a new assessment (id, class, rank).

    What is not assessed any more is cancelled; another class or rank is entered
    anew and drops a planned move; the rest stays.
    """
    a = assessed.select("id", F.col("class").alias("new_class"), F.col("rank").alias("new_rank"), F.lit(True).alias("now"))
    b = queue.withColumn("was", F.lit(True)).join(a, "id", "full_outer")
    same = (F.col("class") == F.col("new_class")) & (F.col("rank") == F.col("new_rank"))
    action = F.when(F.col("now").isNull(), "cancel").when(F.col("was").isNull(), "insert").when(same, "keep").otherwise("rekey")
    b = b.withColumn("action", action)
    return b.select("id", "action", F.coalesce("new_class", "class").alias("class"), F.coalesce("new_rank", "rank").alias("rank"), F.when(F.col("action") == "keep", F.col("move")).alias("move"))


def check_moves(moves: DataFrame, holders: DataFrame, nodes: DataFrame, busy: DataFrame, trimming: DataFrame, factor: int, per_node: int) -> DataFrame:
    """(id, source, target, verdict, spread) of planned moves: dropped, blocked or started.

    A move is dropped unless the chunk has exactly ``factor`` copies, all live, the source
    among them and the target not, no trim runs, and the target is live and active; it is
    blocked while either end has ``per_node`` copies in flight (node, n).  ``spread``: whether the source may
    be trimmed afterwards without a rack less.
    """
    h = holders.join(nodes.select("node", "rack", "alive"), "node")
    g = h.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if("alive").alias("sure"), F.collect_set(F.when(F.col("alive"), F.col("node"))).alias("live"), F.collect_set("node").alias("all"), F.collect_list(F.when(F.col("alive"), F.col("rack"))).alias("racks"))
    end = lambda x: busy.select(F.col("node").alias(x), F.col("n").alias(f"busy_{x}"))
    m = moves.join(g, "id", "left").join(trimming.select("id", F.lit(True).alias("trimming")).distinct(), "id", "left")
    m = m.join(nodes.select(F.col("node").alias("target"), (F.col("alive") & (F.col("admin") == "active")).alias("fit")), "target", "left").join(nodes.select(F.col("node").alias("source"), F.col("rack").alias("own")), "source", "left")
    m = m.join(end("source"), "source", "left").join(end("target"), "target", "left")
    keeps = F.col("trimming").isNull() & (F.col("n") == factor) & (F.col("sure") == factor) & F.array_contains("live", F.col("source")) & ~F.array_contains("all", F.col("target")) & F.col("fit")
    free = (F.coalesce("busy_source", F.lit(0)) < per_node) & (F.coalesce("busy_target", F.lit(0)) < per_node)
    same = F.size(F.filter("racks", lambda r: r == F.col("own")))
    spread = F.coalesce(F.array_contains("live", F.col("source")) & ((same > 1) | (F.size(F.array_distinct("racks")) == F.size("racks"))), F.lit(False))
    return m.select("id", "source", "target", F.when(~F.coalesce(keeps, F.lit(False)), "dropped").when(free, "started").otherwise("blocked").alias("verdict"), spread.alias("spread"))


def balance_input(nodes: DataFrame, locations: DataFrame, chunks: DataFrame, trims: DataFrame, inflight: DataFrame, factor: int) -> tuple[DataFrame, DataFrame]:
    """Node loads (node, rack, used, settled) and chunks (id, size, n, pinned) as a balance plan takes them.

    ``nodes``: (node, rack, state) with states eligible, gone and unsettled; one unsettled member and there is no plan.
    Loads leave out copies under trim (id, node) and count bytes in flight (id, target); a chunk is
    pinned if busy or not at exactly ``factor`` copies.
    """
    members = nodes.filter("state = 'eligible'").select("node", "rack")
    settled = nodes.agg(F.coalesce(~F.bool_or(F.col("state") == "unsettled"), F.lit(False)).alias("settled"))
    copies = locations.join(trims, ["id", "node"], "left_anti").join(F.broadcast(members), "node", "left_semi").join(chunks, "id")
    coming = inflight.select("id", F.col("target").alias("node")).join(chunks, "id")
    load = copies.select("node", "size").unionAll(coming.select("node", "size")).groupBy("node").agg(F.sum("size").alias("used"))
    loads = members.join(load, "node", "left").select("node", "rack", F.coalesce("used", F.lit(0)).alias("used"), F.lit(1).alias("k")).join(settled.withColumn("k", F.lit(1)), "k").drop("k")
    n = copies.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    every = locations.groupBy("id").agg(F.count(F.lit(1)).alias("n_all"))
    busy = trims.select("id").unionAll(inflight.select("id")).distinct().withColumn("busy", F.lit(True))
    c = chunks.join(n, "id", "left").join(every, "id", "left").join(busy, "id", "left").fillna(0, ["n", "n_all"])
    return loads, c.select("id", "size", "n", (F.col("busy").isNotNull() | (F.col("n") != factor) | (F.col("n_all") != factor)).alias("pinned"))


def copy_ends(starts: DataFrame, reports: DataFrame, timeout: int) -> DataFrame:
    """(id, target, at, state, ended): a copy is done at the first report of its chunk by its target (node, chunk, t) within ``timeout``, else it times out."""
    r = reports.select(F.col("chunk").alias("id"), F.col("node").alias("target"), "t")
    got = starts.join(r, ["id", "target"], "left").groupBy("id", "target", "at").agg(F.min(F.when((F.col("t") > F.col("at")) & (F.col("t") <= F.col("at") + timeout), F.col("t"))).alias("t"))
    return got.select("id", "target", "at", F.when(F.col("t").isNull(), "timeout").otherwise("done").alias("state"), F.coalesce("t", F.col("at") + timeout).alias("ended"))


def trim_retries(before: DataFrame, sure: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, victim): of trims to repeat (id, node) for chunks in ``chosen`` (id, victim), the same victim while it is a confirmed holder, else the one chosen now."""
    still = before.join(sure.select("id", "node"), ["id", "node"], "left_semi").select("id", F.col("node").alias("same"))
    return before.select("id").join(chosen, "id").join(still, "id", "left").select("id", F.coalesce("same", "victim").alias("victim"))


def after_election(ready: DataFrame, since: int, grace: int) -> DataFrame:
    """(id, ready): a new leader lets its grace pass before any chunk is ready."""
    return ready.select("id", F.greatest(F.col("ready"), F.lit(since + grace)).alias("ready"))


def floor_breaches(states: DataFrame, target: int, commit: int) -> DataFrame:
    """(id, t, have, floor): the first state (id, t, have, lost) of each chunk below its floor.

    The floor is the smaller of target - 1 and commit, less the copies lost to wipes
    or rot since the chunk was last at its target.
    """
    s = states.withColumn("run", F.sum((F.col("have") >= target).cast("long")).over(_so_far(["id"], "t")))
    s = s.withColumn("debt", F.sum(F.when(F.col("have") >= target, 0).otherwise(F.col("lost"))).over(_so_far(["id", "run"], "t")))
    bad = s.withColumn("floor", F.lit(min(target - 1, commit)) - F.col("debt")).filter((F.col("have") < target) & (F.col("have") < F.col("floor")))
    return bad.groupBy("id").agg(F.min(F.struct("t", "have", "floor")).alias("m")).select("id", "m.t", "m.have", "m.floor")


def scrubbed(nodes: DataFrame, corrupt: DataFrame) -> DataFrame:
    """(node, settled, corrupt): running nodes (node, start, passes), whether two full passes are over, and the corrupt copies (id, node) that are left."""
    bad = corrupt.groupBy("node").agg(F.count(F.lit(1)).alias("corrupt"))
    return nodes.join(bad, "node", "left").select("node", (F.col("passes") >= F.col("start") + 2).alias("settled"), F.coalesce("corrupt", F.lit(0)).alias("corrupt"))


# --- faults, administration -----------------------------------------------------------------------------


def fault_overlaps(faults: DataFrame) -> DataFrame:
    """(node, at, until) of faults that begin before an earlier one of their node has ended."""
    w = Window.partitionBy("node").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return faults.withColumn("busy", F.max("until").over(w)).filter("at < busy").select("node", "at", "until")


def admin_log(events: DataFrame) -> DataFrame:
    """(node, pos, wanted, accepted): draining comes before decommissioned, and a decommissioned node cannot be drained again.

    ``events``: (node, pos, wanted).  The state is folded over the events of a node inside one expression.
    """
    e = F.array_sort(F.collect_list(F.struct("pos", "wanted")))  # the orders for one node
    start = F.struct(F.lit("active").alias("now"), F.array().cast("array<struct<pos:bigint,wanted:string,accepted:boolean>>").alias("out"))

    def step(state, x):
        now, to = state["now"], x["wanted"]
        ok = F.when(to == "decommissioned", now.isin("draining", "decommissioned")).when(to == "draining", now != "decommissioned").otherwise(F.lit(True))
        row = F.struct(x["pos"].cast("long").alias("pos"), to.alias("wanted"), ok.alias("accepted"))
        return F.struct(F.when(ok, to).otherwise(now).alias("now"), F.concat(state["out"], F.array(row)).alias("out"))

    folded = events.groupBy("node").agg(e.alias("e")).select("node", F.aggregate("e", start, step, lambda s: s["out"]).alias("out"))
    return folded.select("node", F.explode("out").alias("x")).select("node", "x.pos", "x.wanted", "x.accepted")


def answers(requests: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``requests`` with the answer of the first of equal ones: a retry gets what the first got."""
    w = Window.partitionBy(*keys).orderBy(order)
    return requests.withColumn("answer", F.first(value).over(w)).withColumn("retry", F.row_number().over(w) > 1)


def peers_view(peers: DataFrame) -> DataFrame:
    """(asked, peer, role, matched): the leader lists all peers, another peer only itself."""
    leader = peers.filter("role = 'leader'").select(F.col("peer").alias("asked"), F.lit(1).alias("k"))
    alone = peers.filter("role <> 'leader'").select(F.col("peer").alias("asked"), "peer", "role", "matched")
    return leader.join(peers.select("peer", "role", "matched", F.lit(1).alias("k")), "k").drop("k").unionByName(alone)  # one leader a term


def unwritten_reads(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Reads whose hash nobody wrote to that path."""
    return reads.join(writes.select("path", "hash").distinct(), ["path", "hash"], "left_anti")


def invariants(checks: dict[str, DataFrame]) -> DataFrame:
    """(invariant, violations): every check is a table that must be empty."""
    out = None
    for name, rows in sorted(checks.items()):
        one = rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("invariant"), "violations")
        out = one if out is None else out.unionAll(one)
    return out

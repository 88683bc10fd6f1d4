"""Repair, trim, placement and rebalancing."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def repair_queue(copies: DataFrame, factor: int) -> DataFrame:
    """(position-free) rows (class, rank, id) of what needs repair: lost chunks have no source and are left out; fewest live copies first."""
    c = copies.filter((F.col("alive") < factor) & (F.col("readable") > 0))
    return c.select(F.when(F.col("alive") == 0, 0).otherwise(1).cast("long").alias("class"), F.col("alive").cast("long").alias("rank"), "id").orderBy("class", "rank", "id")


def _first_missing(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, gap): the smallest number from 1 on that a key's rows lack."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    return rows.select(*keys, number).distinct().withColumn("nth", nth).groupBy(*keys).agg((1 + F.coalesce(F.max(F.when(F.col("nth") == F.col(number), F.col("nth"))), F.lit(0))).alias("gap"))


def repair_targets(needy: DataFrame, locations: DataFrame, nodes: DataFrame, rack_use: DataFrame) -> DataFrame:
    """(id, target): per chunk one more node without a copy, on the racks that it uses least; fast before slow, then least used, then by node.

    Nodes are ranked within their racks and racks by their first node, once.  A rack
    without a copy beats all others, so the first rank that a chunk's racks lack names
    its rack, whose first node holds nothing of it.  Only a chunk that uses every rack
    looks at nodes: of each of its racks at the first place that its holders lack.
    """
    ok = nodes.filter("alive and admin = 'active'").select("node", "rack", "slow", "used")
    best = ok.withColumn("place", F.row_number().over(Window.partitionBy("rack").orderBy("slow", "used", "node")))
    firsts = best.filter("place = 1").withColumn("rk", F.row_number().over(Window.orderBy("slow", "used", "node")))  # a row a rack
    use = rack_use.join(needy.select("id"), "id", "left_semi").join(firsts.select("rack", "rk"), "rack")
    gap = needy.select("id").join(_first_missing(use, ["id"], "rk"), "id", "left").select("id", F.coalesce("gap", F.lit(1)).alias("rk"))
    spare = gap.join(firsts.select("rk", F.col("node").alias("target")), "rk", "left")
    full = spare.filter("target is null").select("id")
    places = locations.join(full, "id", "left_semi").join(best.select("node", "rack", "place"), "node")
    free = use.join(full, "id", "left_semi").join(_first_missing(places, ["id", "rack"], "place"), ["id", "rack"], "left")
    free = free.select("id", "rack", "copies", F.coalesce("gap", F.lit(1)).alias("place")).join(best, ["rack", "place"])
    least = free.groupBy("id").agg(F.min(F.struct("copies", "slow", "used", "node")).alias("m")).select("id", F.col("m.node").alias("target"))
    return spare.filter("target is not null").select("id", "target").unionByName(least)


def trim_victims(locations: DataFrame, nodes: DataFrame, factor: int) -> DataFrame:
    """(id, victim) of chunks with more live copies than the factor: most copies on its rack, then most used, then largest node."""
    h = locations.join(nodes.filter("alive").select("node", "rack", "used"), "node")
    h = h.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("id"))).filter(F.col("copies") > factor)
    h = h.withColumn("on_rack", F.count(F.lit(1)).over(Window.partitionBy("id", "rack")))
    return h.groupBy("id").agg(F.max(F.struct("on_rack", "used", "node")).alias("m")).select("id", F.col("m.node").alias("victim"))


def short_elsewhere(locations: DataFrame, nodes: DataFrame, factor: int) -> DataFrame:
    """(node, short): chunks on each draining node that would have fewer live copies than the factor without it."""
    h = locations.join(nodes.select("node", "alive", "admin"), "node")
    counts = h.groupBy("id").agg(F.count_if(F.col("alive") & (F.col("admin") == "active")).alias("elsewhere"))
    d = h.filter("admin = 'draining'").join(counts, "id")
    return d.groupBy("node").agg(F.count_if(F.col("elsewhere") < factor).alias("short"))


def source_choice(needy: DataFrame, locations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, source): live before silent, then least used, then by node."""
    h = needy.select("id").join(locations, "id").join(nodes.select("node", "alive", "used"), "node")
    return h.groupBy("id").agg(F.min(F.struct((~F.col("alive")).alias("a"), "used", "node")).alias("m")).select("id", F.col("m.node").alias("source"))


def balance_targets(nodes: DataFrame, total: int, rack_cap: int) -> DataFrame:
    """(node, rack, used, target): an even share, with racks that it would overfill held at ``rack_cap``, shared out by water-filling.

    Racks are few: they are ordered by nodes, largest first, and a rack is
    capped if its share of what the capped ones leave exceeds the cap.
    """
    racks = nodes.groupBy("rack").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.orderBy(F.desc("n"), "rack")  # over racks, not nodes
    r = racks.withColumn("i", F.row_number().over(everything) - 1).withColumn("before", F.coalesce(F.sum("n").over(everything.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r = r.withColumn("all", F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    over = F.expr(f"({total} - i * {rack_cap}) * n div (all - before) > {rack_cap}")
    first = r.filter(~over).agg(F.min("i")).first()[0]
    first = r.count() if first is None else first
    r = r.withColumn("capped", F.col("i") < first)
    left = r.agg(F.sum(F.when(~F.col("capped"), F.col("n"))).alias("n")).first()[0] or 0
    share = F.when(F.col("capped"), F.expr(f"{rack_cap} div n")).otherwise(F.expr(f"({total} - {first} * {rack_cap}) div {max(1, left)}"))
    return nodes.join(F.broadcast(r.select("rack", share.cast("long").alias("target"))), "rack").select("node", "rack", "used", "target")


def balance(targets: DataFrame, band: int) -> DataFrame:
    """One row: l1, n_over, n_under, balanced."""
    d = F.col("used") - F.col("target")
    return targets.agg(F.sum(F.abs(d)).alias("l1"), F.count_if(d > band).alias("n_over"), F.count_if(d < -band).alias("n_under")).withColumn("balanced", (F.col("n_over") == 0) & (F.col("n_under") == 0))


def ready_times(expiries: DataFrame, live: DataFrame, target: int) -> DataFrame:
    """(id, ready): when enough excused holders have run out of excuse that the chunk is short: element live + excused - target of the sorted expiries."""
    e = expiries.groupBy("id").agg(F.sort_array(F.collect_list("expires")).alias("at"))
    k = F.col("live") + F.size("at") - target
    return e.join(live, "id").filter((k >= 0) & (k < F.size("at"))).select("id", F.get("at", k.cast("int")).alias("ready"))


# --- greedy plans: each choice changes the next, so they run in one ordered group -------------


def _ordered(df: DataFrame, by: list[str], schema: str, fn) -> DataFrame:
    """``fn`` over all rows in order, in one task, batch by batch: the state it keeps is that of the nodes, not the rows."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        for batch in it:
            yield fn(batch, state)

    return df.repartition(1).sortWithinPartitions(*by).mapInPandas(run, schema)


def place(chunks: DataFrame, nodes: DataFrame, copies: int = 3, least: int = 1) -> DataFrame:
    """(id, node, ordinal): per chunk, in order of id, nodes on the racks that it uses least; fast before slow, then least loaded with what this plan has placed, then by node.

    A load feeds back in every later choice, so the plan is a sequence; only
    the table of nodes is held, as a heap a rack, so a copy costs the racks and the
    logarithm of the nodes.  A chunk for which fewer than ``least`` nodes fit is not placed.
    """
    fixed = [(r.node, r.rack, r.used, r.slow) for r in nodes.filter("alive and admin = 'active'").select("node", "rack", "used", "slow").collect()]  # the membership

    def step(batch: pd.DataFrame, state: dict) -> pd.DataFrame:
        if not state:
            for n, r, used, slow in fixed:
                state.setdefault(r, []).append((slow, used, n))
            for heap in state.values():
                heapify(heap)
        out = []
        for i, size in zip(batch["id"], batch["size"], strict=True):
            use: dict = {}
            taken: list = []
            for _ in range(copies):
                free = [(use.get(r, 0), heap[0], r) for r, heap in state.items() if heap]
                if not free:
                    break
                _, top, r = min(free)
                heappop(state[r])  # not to be taken twice
                taken.append((r, top))
                use[r] = use.get(r, 0) + 1
            fits = len(taken) >= least
            for k, (r, (slow, load, n)) in enumerate(taken):
                heappush(state[r], (slow, load + size if fits else load, n))
                if fits:
                    out.append((i, n, k))
        return pd.DataFrame(out, columns=["id", "node", "ordinal"])

    return _ordered(chunks.select("id", "size"), ["id"], "id long, node long, ordinal long", step)


def move_plan(targets: DataFrame, holdings: DataFrame, band: int, limit: int) -> DataFrame:
    """(step, id, source, destination, size): greedy moves from the node most over its target to the one most under.

    Acts only while some node is further than ``band`` from its target; then every node above its target is a source and
    every node below a destination.  The largest chunk that fits both gaps is moved, else the smallest with size
    below excess plus deficit; never to a node that has a copy, nor so that the chunk uses fewer racks.
    ``holdings``: (id, node, rack, size).  At most ``limit`` moves are planned at a time, all if it is 0.

    The driver holds the membership and the moves; each move is chosen by an aggregate over the chunks, one row per
    source and destination: of the first source alone, and of all others only if that has no move.
    """
    spark = targets.sparkSession
    t = targets.collect()  # the membership
    gap = {r.node: r.used - r.target for r in t}
    rack = {r.node: r.rack for r in t}
    out: list[tuple] = []
    schema = "step long, id long, source long, destination long, size long"
    if all(abs(x) <= band for x in gap.values()):
        return spark.createDataFrame(out, schema)
    rows = holdings.groupBy("id").agg(F.first("size").cast("long").alias("size"), F.collect_set(F.struct("node", "rack")).alias("holders")).persist()
    now: dict = {}  # holders of the chunks moved so far
    pair_schema = "s long, s_rack string, excess long, d long, d_rack string, deficit long"

    def choose(sources: list, dests: list) -> dict:
        pairs = spark.createDataFrame([(s, str(rack[s]), gap[s], d, str(rack[d]), -gap[d]) for s in sources for d in dests], pair_schema)
        at = rows.filter(~F.col("id").isin(list(now))) if now else rows
        if now:
            at = at.unionByName(spark.createDataFrame([(i, size, list(h.items())) for i, (size, h) in now.items()], rows.schema))
        on = at.withColumn("s", F.explode("holders.node")).join(F.broadcast(pairs), "s").filter("size < excess + deficit")
        on = on.filter(
            """not exists(holders, h -> h.node = d) and (s_rack = d_rack or exists(holders, h -> h.node <> s and cast(h.rack as string) = s_rack)
            or not exists(holders, h -> h.node <> s and cast(h.rack as string) = d_rack))"""
        )
        small = F.struct("size", "id", "holders")
        fit = F.when(F.col("size") <= F.least("excess", "deficit"), F.struct((-F.col("size")).alias("order"), "id", "size", "holders"))
        return {(r.s, r.d): r.fit or r.small for r in on.groupBy("s", "d").agg(F.min(fit).alias("fit"), F.min(small).alias("small")).collect()}

    try:
        while limit <= 0 or len(out) < limit:
            sources = sorted((n for n, x in gap.items() if x > 0), key=lambda n: (-gap[n], n))
            dests = sorted((n for n, x in gap.items() if x < 0), key=lambda n: (gap[n], n))
            best = None
            for some in (sources[:1], sources[1:]):
                found = choose(some, dests) if some and dests else {}
                best = next(((s, d, found[s, d]) for s in some for d in dests if (s, d) in found), None)
                if best:
                    break
            if not best:
                break
            s, d, c = best
            holders = {h.node: h.rack for h in c.holders if h.node != s}
            now[c.id] = (c.size, {**holders, d: rack[d]})
            gap[s] -= c.size
            gap[d] += c.size
            out.append((len(out), c.id, s, d, c.size))
    finally:
        rows.unpersist()
    return spark.createDataFrame(out, schema)


def dispatch(queue: DataFrame, in_flight: int = 8, per_node: int = 2) -> DataFrame:
    """(round, id, source, target): rounds of copies with at most ``in_flight`` at once and ``per_node`` per source and per target; blocked items are skipped, not dropped.

    ``queue``: (class, rank, id, source, target).  A round ends when nothing more fits; a lower class waits for the higher.
    Each item goes to the first round of its class that has a slot left by the items before it, which are the same
    rounds; only rounds that are not full are kept, so batches do not matter.
    """

    def step(batch: pd.DataFrame, state: dict) -> pd.DataFrame:
        out = []
        for c, i, s, t in zip(batch["class"], batch["id"], batch["source"], batch["target"], strict=True):
            if state.get("class", c) != c:
                state.update(base=state["top"] + 1, least={}, open={})
            state["class"] = c
            number, least, rounds = state.setdefault("base", 0), state.setdefault("least", {}), state.setdefault("open", {})
            number = max(number, least.get(("s", s), 0), least.get(("t", t), 0))
            while True:
                took = rounds.setdefault(number, {}) if number > state.get("top", -1) else rounds.get(number)
                if took is not None and took.get(("s", s), 0) < per_node and took.get(("t", t), 0) < per_node:
                    break
                number += 1
            for key in (("s", s), ("t", t), "all"):
                took[key] = took.get(key, 0) + 1
            state["top"] = max(state.get("top", -1), number)
            out.append((number, i, s, t))
            if took["all"] == in_flight:
                del rounds[number]
                while state["base"] <= state["top"] and state["base"] not in rounds:
                    state["base"] += 1
            for key in (("s", s), ("t", t)):  # rounds before the first with a slot for this node
                first = max(state["base"], least.get(key, 0))
                while first <= state["top"] and (first not in rounds or rounds[first].get(key, 0) >= per_node):
                    first += 1
                least[key] = first
        return pd.DataFrame(out, columns=["round", "id", "source", "target"])

    return _ordered(queue.select("class", "rank", "id", "source", "target"), ["class", "rank", "id"], "round long, id long, source long, target long", step)

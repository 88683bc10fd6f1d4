"""Cluster state: failure detection, block reports, locations, replica health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def detector(beats: DataFrame, on_time: int, suspect: int) -> DataFrame:
    """(node, seq, t, state) at each heartbeat, under continuous ticks.

    A gap above ``suspect`` or a restart opens a segment, one above ``on_time`` a
    run; in segments after the first a node is alive again once a run has three beats.
    """
    order = Window.partitionBy("node").orderBy("t", "seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.col("t") - F.lag("t").over(order)
    b = beats.withColumn("gap", gap).withColumn("fresh", F.col("restarted") & F.col("gap").isNotNull())
    b = b.withColumn("seg", F.sum((F.coalesce(F.col("gap") > suspect, F.lit(False)) | F.col("fresh")).cast("long")).over(so_far))
    b = b.withColumn("run", F.sum((F.coalesce(F.col("gap") > on_time, F.lit(False)) | F.col("fresh")).cast("long")).over(so_far))
    b = b.withColumn("rn", F.row_number().over(Window.partitionBy("node", "seg", "run").orderBy("t", "seq")))
    streak = F.max((F.col("rn") >= 3).cast("int")).over(Window.partitionBy("node", "seg").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0))
    return b.select("node", "seq", "t", F.when((F.col("seg") == 0) | (streak == 1), "alive").otherwise("suspect").alias("state"))


def transitions(beats: DataFrame, on_time: int, suspect: int, dead: int) -> DataFrame:
    """(node, t, state): every change, with silence becoming suspect and then dead between beats; the first state is a change too."""
    order = Window.partitionBy("node").orderBy("t", "seq")
    d = detector(beats, on_time, suspect).withColumn("next_t", F.lead("t").over(order))
    points = F.array(
        F.struct(F.col("t").alias("at"), F.col("state").alias("now")),
        F.struct((F.col("t") + suspect).alias("at"), F.lit("suspect").alias("now")),
        F.struct((F.col("t") + dead).alias("at"), F.lit("dead").alias("now")),
    )
    silent = F.filter(points, lambda p: (p["at"] == F.col("t")) | F.col("next_t").isNull() | (p["at"] < F.col("next_t")))
    flat = d.select("node", "seq", F.explode(silent).alias("p")).select("node", "seq", F.col("p.at").alias("t"), F.col("p.now").alias("state"))
    changed = F.lag("state").over(Window.partitionBy("node").orderBy("t", "seq", "state"))
    return flat.withColumn("was", changed).filter("was is null or was <> state").select("node", "t", "state")


def deduplicate_beats(beats: DataFrame) -> DataFrame:
    """Heartbeats that count, in order of arrival ``t``: those with a number above all before, per node and incarnation."""
    w = Window.partitionBy("node", "incarnation").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return beats.withColumn("before", F.max("seq").over(w)).filter("before is null or seq > before").drop("before")


def latest_nodes(beats: DataFrame) -> DataFrame:
    """(node, seq, t, beats): the newest heartbeat of each node replaces what was known."""
    return beats.groupBy("node").agg(F.max(F.struct("seq", "t")).alias("m"), F.count(F.lit(1)).alias("beats")).select("node", F.col("m.seq").alias("seq"), F.col("m.t").alias("t"), "beats")


def reconcile_reports(reports: DataFrame) -> DataFrame:
    """(node, chunk): copies after the latest full report and all later increments; last action by seq wins, delete before add within one.

    ``reports``: (node, chunk, action, seq, is_full), a row a chunk; a full report lists what is there.
    """
    last = reports.filter("is_full").groupBy("node").agg(F.max("seq").alias("base"))
    r = reports.join(last, "node", "left").filter("base is null or seq > base or (seq = base and is_full)")
    order = F.struct("seq", (F.col("action") == "delete").cast("int").alias("gone"))
    return r.groupBy("node", "chunk").agg(F.max(order).alias("m")).filter("m.gone = 0").select("node", "chunk")


def report_deltas(known: DataFrame, listed: DataFrame) -> DataFrame:
    """(node, chunk, change): added and removed by a full report against what was known."""
    k, n = known.select("node", "chunk", F.lit(True).alias("k")), listed.select("node", "chunk", F.lit(True).alias("n"))
    both = k.join(n, ["node", "chunk"], "full_outer").filter("k is null or n is null")
    return both.select("node", "chunk", F.when(F.col("k").isNull(), "added").otherwise("removed").alias("change"))


def confirm_reports(sent: DataFrame, got: DataFrame, full: DataFrame) -> DataFrame:
    """(node, seq, received): a sent number is received if it was got itself or a full report covers it."""
    s = sent.join(got.select("node", "seq", F.lit(True).alias("hit")).distinct(), ["node", "seq"], "left").join(full.groupBy("node").agg(F.max("seq").alias("full")), "node", "left")
    return s.select("node", "seq", (F.coalesce("hit", F.lit(False)) | F.coalesce(F.col("seq") <= F.col("full"), F.lit(False))).alias("received"))


def live_locations(locations: DataFrame, nodes: DataFrame, deleting: DataFrame, trimming: DataFrame) -> DataFrame:
    """Copies on live nodes that are neither being deleted nor trimmed nor on a decommissioned node."""
    up = nodes.filter("alive and admin <> 'decommissioned'").select("node")
    return locations.join(up, "node", "left_semi").join(deleting, ["id", "node"], "left_anti").join(trimming, ["id", "node"], "left_anti").select("id", "node")


def replicas(chunks: DataFrame, locations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, alive, readable): copies on live nodes, and copies at all."""
    copies = locations.join(nodes.select("node", "alive"), "node").groupBy("id").agg(F.count_if("alive").alias("alive"), F.count(F.lit(1)).alias("readable"))
    return chunks.select("id", "size").join(copies, "id", "left").select("id", "size", F.coalesce("alive", F.lit(0)).alias("alive"), F.coalesce("readable", F.lit(0)).alias("readable"))


def replica_histogram(copies: DataFrame, factor: int) -> DataFrame:
    """(copies, n_chunks); the last bucket is "more than the factor"."""
    return copies.groupBy(F.least("alive", F.lit(factor + 1)).cast("long").alias("copies")).agg(F.count(F.lit(1)).alias("n_chunks"))


def health(copies: DataFrame, factor: int) -> DataFrame:
    """One row: lost (also counted under), under, over, n_chunks."""
    return copies.agg(F.count_if(F.col("readable") == 0).alias("lost"), F.count_if(F.col("alive") < factor).alias("under"), F.count_if(F.col("alive") > factor).alias("over"), F.count(F.lit(1)).alias("n_chunks"))


def file_health(references: DataFrame, copies: DataFrame, factor: int) -> DataFrame:
    """(version, min_copies, below): least live copies over a file's chunks, at most the factor, and chunks below it."""
    r = references.select("version", "id").join(copies.select("id", "alive"), "id")
    return r.groupBy("version").agg(F.least(F.min("alive"), F.lit(factor)).cast("long").alias("min_copies"), F.count_if(F.col("alive") < factor).alias("below"))


def node_usage(locations: DataFrame, chunks: DataFrame) -> DataFrame:
    """(node, n_chunks, bytes): each chunk once."""
    return locations.distinct().join(chunks, "id").groupBy("node").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("size").alias("bytes"))


def stripe_health(shards: DataFrame, copies: DataFrame) -> DataFrame:
    """(stripe, readable, alive, state) of stripes of four data and two parity shards (stripe, slot, id).

    Fewer than four readable shards lose it, fewer than six live ones leave it
    under, and only else does a shard with several copies make it over.
    """
    s = shards.join(copies.select("id", F.col("alive").alias("a"), F.col("readable").alias("r")), "id", "left")
    g = s.groupBy("stripe").agg(
        F.sum(F.least(F.coalesce("r", F.lit(0)), F.lit(1))).alias("readable"), F.sum(F.least(F.coalesce("a", F.lit(0)), F.lit(1))).alias("alive"), F.max(F.coalesce("a", F.lit(0))).alias("most")
    )
    state = F.when(F.col("readable") < 4, "lost").when(F.col("alive") < 6, "under").when(F.col("most") > 1, "over").otherwise("ok")
    return g.select("stripe", "readable", "alive", state.alias("state"))


def manifest(references: DataFrame, locations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(version, idx, id, size, replicas): replicas as text, live before silent, fast before slow, then by node."""
    held = locations.join(nodes.select("node", "alive", "slow"), "node")
    held = held.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((~F.col("alive")).alias("a"), F.col("slow").alias("s"), "node"))).alias("r"))
    text = F.concat_ws(",", F.transform("r", lambda x: x["node"].cast("string")))
    return references.join(held, "id", "left").select("version", "idx", "id", "size", F.coalesce(text, F.lit("")).alias("replicas"))


def marked(referenced: DataFrame, claimed: DataFrame, shards: DataFrame) -> DataFrame:
    """Ids that garbage collection must keep: referenced, claimed, or a shard of a known stripe."""
    return referenced.select("id").union(claimed.select("id")).union(shards.select("id")).distinct()


def orphans(locations: DataFrame, keep: DataFrame) -> DataFrame:
    return locations.join(keep, "id", "left_anti").select("id", "node")


def collectable(sweeps: DataFrame, grace: int) -> DataFrame:
    """(id, first_seen, t): orphans seen without a gap for ``grace``; being marked or gone in a sweep starts anew.

    ``sweeps``: (id, t, orphan), a row a sweep in which the id was looked at.
    """
    order = Window.partitionBy("id").orderBy("t")
    s = sweeps.withColumn("island", F.sum((~F.col("orphan")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.filter("orphan").withColumn("first_seen", F.min("t").over(Window.partitionBy("id", "island")))
    return s.filter(F.col("t") - F.col("first_seen") >= grace).groupBy("id", "first_seen").agg(F.min("t").alias("t"))


def rack_counts(locations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, rack, copies)."""
    return locations.join(nodes.select("node", "rack"), "node").groupBy("id", "rack").agg(F.count(F.lit(1)).alias("copies"))


def node_states(nodes: DataFrame) -> DataFrame:
    """(state, n)."""
    return nodes.groupBy(F.when(F.col("alive"), "alive").otherwise("dead").alias("state")).agg(F.count(F.lit(1)).alias("n"))


def wanted_blocks(chunks: DataFrame, shards: DataFrame, factor: int) -> DataFrame:
    """(id, target): replicated chunks want the factor, shards one copy; an id that is both is a chunk."""
    c = chunks.select("id", F.lit(factor).cast("long").alias("target"))
    return c.unionByName(shards.select("id").distinct().join(c, "id", "left_anti").select("id", F.lit(1).cast("long").alias("target")))


def siblings(shards: DataFrame, holders: DataFrame) -> DataFrame:
    """(stripe, slot, sibling_slot, node): usable holders of the other shards of a stripe."""
    a, b = shards.select("stripe", "slot"), shards.select("stripe", F.col("slot").alias("sibling_slot"), "id")
    return a.join(b, "stripe").filter("slot <> sibling_slot").join(holders, "id").select("stripe", "slot", "sibling_slot", "node")


def phantoms(reported: DataFrame, on_disk: DataFrame, grace: int) -> DataFrame:
    """(id, node, since, until): copies reported but not on disk at every probe for longer than ``grace``.

    ``reported`` and ``on_disk``: (t, id, node), a row a probe.
    """
    missing = reported.join(on_disk, ["t", "id", "node"], "left_anti")
    probes = reported.select("t").distinct()
    number = probes.withColumn("probe", F.rank().over(Window.orderBy("t")))  # a row a probe, not a row a copy
    m = missing.join(F.broadcast(number), "t")
    w = Window.partitionBy("id", "node").orderBy("t")
    m = m.withColumn("island", F.col("probe") - F.row_number().over(w))
    g = m.groupBy("id", "node", "island").agg(F.min("t").alias("since"), F.max("t").alias("until"))
    return g.filter(F.col("until") - F.col("since") > grace).select("id", "node", "since", "until")

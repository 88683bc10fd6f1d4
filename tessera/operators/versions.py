"""Versioned namespace: live views, logs, retention, leases, quotas, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def valid_path(path: Column) -> Column:
    """Absolute, not the root, clean, without NUL."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/", -1)
    return path.startswith("/") & (path != "/") & ~F.exists(parts, lambda x: x.isin("", ".", "..")) & ~path.contains("\0")


def namespace(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(2))


def live(versions: DataFrame) -> DataFrame:
    """The newest version of each path unless it is a tombstone."""
    return versions.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("v")))).filter("n = 1 and not tombstone").drop("n")


def deleted(versions: DataFrame) -> DataFrame:
    """Paths whose newest version is a tombstone, with their newest data version."""
    newest = F.max_by("tombstone", "v").alias("gone")
    last = F.max(F.when(~F.col("tombstone"), F.struct("v", "size"))).alias("last")
    return versions.groupBy("path").agg(newest, last).filter("gone and last is not null").select("path", F.col("last.v").alias("v"), F.col("last.size").alias("size"))


def lookup(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, v, size) for ``wanted`` (path, v): v = 0 is the live version, a tombstone is not readable."""
    exact = versions.filter("not tombstone").join(wanted.filter("v > 0"), ["path", "v"]).select("path", "v", "size")
    return exact.unionByName(live(versions).join(wanted.filter("v = 0").select("path"), "path").select("path", "v", "size"))


def version_log(versions: DataFrame, retain: int, own: DataFrame | None = None) -> DataFrame:
    """(path, v, size, tombstone, retired_at, expires): a version is retired in the epoch of its successor and expires ``retain`` epochs later.

    ``own`` (path, epochs) overrides the default; 0 means default.
    """
    w = Window.partitionBy("path").orderBy("v")
    out = versions.withColumn("retired_at", F.lead("epoch").over(w))
    out = out.join(own, "path", "left") if own is not None else out.withColumn("epochs", F.lit(0))
    keep = F.coalesce(F.when(F.col("epochs") > 0, F.col("epochs")), F.lit(retain))
    return out.select("path", "v", "size", "tombstone", "retired_at", (F.col("retired_at") + keep).cast("long").alias("expires"))


def sweep(versions: DataFrame, retain: int, now: int, own: DataFrame | None = None) -> DataFrame:
    """(path, v, retired_at) that are dropped at epoch ``now``: not the newest, and expired."""
    return version_log(versions, retain, own).filter(F.col("expires") <= now).select("path", "v", "retired_at")


def expired_leases(touches: DataFrame, lease: int, now: int) -> DataFrame:
    """(upload, touched) whose last begin or claim lies ``lease`` epochs back; a lease of 0 never expires."""
    t = touches.groupBy("upload").agg(F.max("epoch").alias("touched"))
    return t.filter((F.lit(lease) > 0) & (F.col("touched") + lease <= now))


def namespace_usage(live_files: DataFrame, uploads: DataFrame) -> DataFrame:
    """(ns, used): live bytes and pending uploads; namespaces with nothing are absent."""
    both = live_files.select("ns", "size").unionAll(uploads.select("ns", "size"))
    return both.groupBy("ns").agg(F.sum("size").alias("used")).filter("used <> 0")


def quota_refusals(requests: DataFrame, quotas: DataFrame) -> DataFrame:
    """(ns, seq, size, before) refused in order of ``seq`` if used + size > limit, had all before been granted; limit 0 or less is no limit."""
    w = Window.partitionBy("ns").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    r = requests.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0))).join(quotas, "ns")
    return r.filter("quota > 0 and before + size > quota").select("ns", "seq", "size", "before")


def manifest_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of same, changed, added and removed indexes, and shared and new bytes, per key: a full outer join on the index."""
    a = old.select(*keys, "idx", F.col("id").alias("id_a"), F.col("size").alias("size_a"))
    b = new.select(*keys, "idx", F.col("id").alias("id_b"), F.col("size").alias("size_b"))
    j = a.join(b, [*keys, "idx"], "full_outer")
    same = F.col("id_a") == F.col("id_b")
    return j.groupBy(*keys).agg(
        F.count_if(same).alias("same"),
        F.count_if(F.col("id_a") != F.col("id_b")).alias("changed"),
        F.count_if(F.col("id_a").isNull()).alias("added"),
        F.count_if(F.col("id_b").isNull()).alias("removed"),
        F.coalesce(F.sum(F.when(same, F.col("size_b"))), F.lit(0)).alias("shared_bytes"),
        F.coalesce(F.sum(F.when(F.col("id_b").isNotNull() & ~F.coalesce(same, F.lit(False)), F.col("size_b"))), F.lit(0)).alias("new_bytes"),
    )


def resume_offset(claims: DataFrame, durable: DataFrame) -> DataFrame:
    """(version, claimed_run, present_run): chunks claimed without a gap from index 0, and those of them that are durable without a gap."""
    w = Window.partitionBy("version").orderBy("idx")
    run = claims.join(durable.select("id", F.lit(True).alias("have")).distinct(), "id", "left")
    run = run.withColumn("in_run", F.col("idx") == F.row_number().over(w) - 1).withColumn("ok", F.min(F.coalesce("have", F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    return run.groupBy("version").agg(F.count_if("in_run").alias("claimed_run"), F.count_if(F.col("in_run") & F.col("ok")).alias("present_run"))


def append_checks(appends: DataFrame, chunk: int) -> DataFrame:
    """(…, verdict) of resumable appends (size, claimed_run, offset, length): the offset must be a chunk boundary within the claimed run, the length whole chunks or up to the end."""
    end = F.col("offset") + F.col("length")
    return appends.withColumn(
        "verdict",
        F.when((F.col("offset") < 0) | (F.col("length") < 0) | (F.col("offset") > F.col("size")) | (F.col("length") > F.col("size") - F.col("offset")), "out of range")
        .when(F.col("offset") % chunk != 0, "not a boundary")
        .when(F.col("offset") > F.col("claimed_run") * chunk, "beyond claimed")
        .when((F.col("length") % chunk != 0) & (end != F.col("size")), "part of a chunk")
        .when(end == F.col("size"), "commit")
        .otherwise("accept"),
    )

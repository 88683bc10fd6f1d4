"""Latency, throughput and timeline reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(samples: DataFrame, keys: list[str], value: str, percents: list[int]) -> DataFrame:
    """Percentile by nearest index: of n sorted values the one at min(n - 1, n * p div 100).

    Values are counted first and only distinct ones are ranked, in a window per key, so no
    list of all values of a key is ever built.
    """
    counts = samples.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(*keys)
    c = counts.withColumn("_upto", F.sum("_k").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_k").over(w))
    at = lambda p: F.least(F.col("_n") - 1, F.expr(f"_n * {p} div 100"))
    return c.groupBy(*keys).agg(F.max("_n").alias("samples"), *[F.min(F.when(F.col("_upto") > at(p), F.col(value))).alias(f"p{p}") for p in percents])


def upper_median(samples: DataFrame, keys: list[str], value: str, least: int = 3) -> DataFrame:
    """Value at _n div 2 of the sorted positive ones; null below ``least`` samples."""
    counts = samples.filter(F.col(value) > 0).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(*keys)
    c = counts.withColumn("_upto", F.sum("_k").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_k").over(w))
    return c.groupBy(*keys).agg(F.max("_n").alias("samples"), F.when(F.max("_n") >= least, F.min(F.when(F.col("_upto") > F.expr("_n div 2"), F.col(value)))).alias("median"))


def in_phases(samples: DataFrame, phases: list[tuple[str, int, int]], t: str = "t") -> DataFrame:
    """``samples`` with the phase [start, end) in which they end; phases are a short list, so the interval join is an expression."""
    which = F.lit(None).cast("string")
    for name, start, end in reversed(phases):
        which = F.when((F.col(t) >= start) & (F.col(t) < end), name).otherwise(which)
    return samples.withColumn("phase", which).filter("phase is not null")


def hedge_delay(reads: DataFrame, keys: list[str], last: int = 128, low: int = 20_000, high: int = 500_000, early: int = 100_000) -> DataFrame:
    """(keys, samples, delay_us): 95th percentile of the last good reads, clamped; a fixed delay before 16 samples."""
    w = Window.partitionBy(*keys).orderBy(F.desc("t"), F.desc("seq"))
    recent = reads.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= last)
    p = nearest_rank(recent, keys, "latency_us", [95])
    return p.select(*keys, "samples", F.when(F.col("samples") < 16, early).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.col("p95")))).cast("long").alias("delay_us"))


def hedged(calls: DataFrame, delay: int) -> DataFrame:
    """(call, latency_us): with a second try after ``delay`` the call ends with the first of both. ``calls``: (call, attempt, latency_us)."""
    return calls.groupBy("call").agg(F.min(F.col("latency_us") + F.col("attempt") * delay).alias("latency_us"))


def quorum(calls: DataFrame, k: int, grace: int = 0) -> DataFrame:
    """(call, latency_us): end of the k-th of a call's answers, plus a grace for the rest; null if fewer answered."""
    got = F.sort_array(F.collect_list("latency_us"))
    return calls.groupBy("call").agg(got.alias("l")).select("call", (F.get("l", F.lit(k - 1)) + grace).alias("latency_us"))


def tally(ops: DataFrame, keys: list[str]) -> DataFrame:
    return ops.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def leader_deltas(counters: DataFrame) -> DataFrame:
    """(node, total): counter increases between successive samples of one leader; a fall or a change of leader adds nothing. ``counters``: (node, t, seq, leader, value)."""
    w = Window.partitionBy("node").orderBy("t", "seq")
    d = F.col("value") - F.lag("value").over(w)
    c = counters.withColumn("d", F.when((F.col("leader") == F.lag("leader").over(w)) & (d >= 0), d).otherwise(0))
    return c.groupBy("node").agg(F.sum("d").alias("total"))


def peak_in_flight(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, peak): most of (start, end) at once; what ends at a time leaves before what starts then comes."""
    events = spans.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e")).select(*keys, "e.at", "e.d")
    steps = events.groupBy(*keys, "at", "d").agg(F.sum("d").alias("d_sum"))
    w = Window.partitionBy(*keys).orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("level", F.sum("d_sum").over(w)).groupBy(*keys).agg(F.greatest(F.max("level"), F.lit(0)).alias("peak"))


def peak_rate(transfers: DataFrame, key: str, window: int = 1_000_000) -> DataFrame:
    """(key, peak): largest bytes a second over greedy windows of at least ``window`` µs: a window ends with the first sample that is far enough from its start."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "seq"])
        start, total, best = None, 0, 0.0
        for t, b in zip(rows["t"], rows["bytes"], strict=True):
            if start is None:
                start = t
                continue
            total += b
            if t - start >= window:
                best, start, total = max(best, total * 1e6 / (t - start)), t, 0
        return pd.DataFrame({key: [rows[key].iloc[0]], "peak": [round(best, 3)]})

    return transfers.select(key, "t", "seq", "bytes").groupBy(key).applyInPandas(run, f"{key} {transfers.schema[key].dataType.simpleString()}, peak double")


def throughput(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, runs, mib_s): mean over runs of MiB a second, to three places; runs without time are left out."""
    r = runs.filter("us > 0").withColumn("rate", F.col("bytes") / 1048576.0 / (F.col("us") / 1e6))
    return r.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum(F.col("rate").cast("decimal(28,9)")).cast("double") / F.count(F.lit(1)), 3).alias("mib_s"))


def first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values in the order in which they first come."""
    return rows.groupBy(value).agg(F.min(order).alias("first")).orderBy("first", value)


def first_match(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Per keys the value of the first row; null becomes 0."""
    return rows.groupBy(*keys).agg(F.min(F.struct(order, value)).alias("m")).select(*keys, F.coalesce(F.col(f"m.{value}"), F.lit(0)).alias(value))


def ring_after(events: DataFrame, after: int, ring: int = 500) -> DataFrame:
    """Retained events behind a cursor: the last ``ring``, and of them those after ``after``; a latest number below the cursor means a restart, and all are new."""
    latest = events.agg(F.max("seq")).first()[0]
    if latest is None:
        return events
    return events.filter(F.col("seq") > max(latest - ring, after if latest >= after else 0))


def tone(text: Column) -> Column:
    """Of a timeline line: good, bad, warn or plain."""
    return F.when(text.rlike("alive|repaired|committed|purchase"), "good").when(text.rlike("dead|lost|corrupt|error"), "bad").when(text.rlike("suspect|slow|signup"), "warn").otherwise("plain")


# --- recurrences: each value depends on the one before; a fold over one key's sorted rows --------------


def _fold(df: DataFrame, key: str, columns: list[str], schema: str, start, step) -> DataFrame:
    """``step(state, row) -> (state, out)`` over the rows of each key in order of (t, seq), in constant memory whatever the key's size.

    Rows are dealt by key and sorted by Spark, so a key spills instead of being collected.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for batch in it:
            out = []
            for row in batch.itertuples(index=False):
                if row[0] != last:
                    last, state = row[0], start()
                state, got = step(state, row)
                out.append(got)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(key, "t", "seq", *columns).repartition(parts, key).sortWithinPartitions(key, "t", "seq").mapInPandas(run, schema)


def token_bucket(requests: DataFrame, key: str, rate: float, burst: float) -> DataFrame:
    """(key, seq, allowed, level): refills at ``rate`` a second up to ``burst``, full at first use; a take of n is allowed at a level of min(n, burst) and may leave a debt. ``requests`` has n."""

    def step(state, row):
        level, at = state if state else (burst, row.t)
        level = min(burst, level + (row.t - at) / 1e6 * rate)
        ok = level >= min(row.n, burst)
        return (level - row.n if ok else level, row.t), (row[0], row.seq, ok, round(level - row.n if ok else level, 6))

    return _fold(requests, key, ["n"], f"{key} long, seq long, allowed boolean, level double", lambda: None, step)


def ewma(samples: DataFrame, key: str) -> DataFrame:
    """(key, seq, score): whole numbers with weight 1/4; the first sample sets, and so does one after a score of 0, which counts as unset; division truncates towards zero."""

    def step(state, row):
        v = int(row.latency_us)
        if state:
            d = v - state
            v = state + (abs(d) // 4) * (1 if d >= 0 else -1)
        return v, (row[0], row.seq, v)

    return _fold(samples, key, ["latency_us"], f"{key} long, seq long, score long", lambda: None, step)


def slow_flags(scores: DataFrame, key: str, need: int = 3) -> DataFrame:
    """(key, seq, slow): set after ``need`` scores above max(3 m, m + 100 ms), cleared after as many below max(2 m, m + 50 ms). ``scores`` has score and median, in µs."""

    def step(state, row):
        slow, run = state
        m = row.median
        hit = row.score < max(2 * m, m + 50_000) if slow else row.score > max(3 * m, m + 100_000)
        run = run + 1 if hit else 0
        if run >= need:
            slow, run = not slow, 0
        return (slow, run), (row[0], row.seq, slow)

    return _fold(scores, key, ["score", "median"], f"{key} long, seq long, slow boolean", lambda: (False, 0), step)

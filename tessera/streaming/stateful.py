"""Continuous forms of the cluster computations: keyed state in Structured Streaming.

Order is told by (incarnation, seq), never by a clock; a watermark only bounds
state.  State lives in the configured state store (RocksDB for large node
counts), one entry per node.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def beats_once(beats: DataFrame) -> DataFrame:
    """Stream of heartbeats (node, incarnation, seq, t) without those whose number is not above the last of the incarnation."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        incarnation, last = state.get if state.exists else (None, -1)
        for batch in batches:
            keep = []
            for r in batch.sort_values(["t", "seq"]).itertuples(index=False):
                if r.incarnation != incarnation:
                    incarnation, last = r.incarnation, -1
                if r.seq > last:
                    last = r.seq
                    keep.append((key[0], r.incarnation, r.seq, r.t))
            yield pd.DataFrame(keep, columns=["node", "incarnation", "seq", "t"])
        state.update((incarnation, last))

    schema = "node long, incarnation string, seq long, t long"
    return beats.select("node", "incarnation", "seq", "t").groupBy("node").applyInPandasWithState(step, schema, "incarnation string, last long", "append", GroupStateTimeout.NoTimeout)


class Detector:
    """Failure detector of one node, with ticks and the stall guard. Times in milliseconds."""

    def __init__(self, on_time: int = 1500, suspect: int = 3000, dead: int = 10_000, tick: int = 500, need: int = 3):
        self.on_time, self.suspect, self.dead, self.tick_every, self.need = on_time, suspect, dead, tick, need
        self.state, self.last, self.streak, self.seq, self.ticked = "", 0, 0, -1, None

    def beat(self, t: int, seq: int, restarted: bool = False) -> list[tuple[int, str]]:
        if not restarted and seq <= self.seq:
            return []
        gap, self.seq = t - self.last, seq
        was, self.last = self.state, t
        if not was:
            self.state, self.streak = "alive", self.need
        elif restarted:
            self.state, self.streak = "suspect", 1
        elif was != "alive" or gap > self.suspect:
            self.streak = self.streak + 1 if gap <= self.on_time and was == "suspect" else 1
            self.state = "alive" if self.streak >= self.need else "suspect"
        return [(t, self.state)] if self.state != was else []

    def tick(self, t: int) -> list[tuple[int, str]]:
        if self.ticked is not None and t - self.ticked > 2 * self.tick_every:  # we stalled, not the node
            self.last += t - self.ticked - self.tick_every
        self.ticked = t
        out = []
        if self.state == "alive" and t - self.last > self.suspect:
            self.state, self.streak = "suspect", 0
            out.append((t, "suspect"))
        if self.state == "suspect" and t - self.last > self.dead:
            self.state, self.streak = "dead", 0
            out.append((t, "dead"))
        return out


def detect(events: DataFrame, **limits: int) -> DataFrame:
    """Stream (node, t, state) of transitions from a stream (node, t, seq, restarted, kind) of beats and ticks."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        d = Detector(**limits)
        if state.exists:
            d.state, d.last, d.streak, d.seq, d.ticked = state.get
            d.ticked = None if d.ticked < 0 else d.ticked
        for batch in batches:
            out = []
            for r in batch.sort_values(["t", "seq"]).itertuples(index=False):
                got = d.beat(r.t, r.seq, bool(r.restarted)) if r.kind == "beat" else d.tick(r.t)
                out += [(key[0], t, s) for t, s in got]
            yield pd.DataFrame(out, columns=["node", "t", "state"])
        state.update((d.state, d.last, d.streak, d.seq, -1 if d.ticked is None else d.ticked))

    return events.select("node", "t", "seq", "restarted", "kind").groupBy("node").applyInPandasWithState(
        step, "node long, t long, state string", "state string, last long, streak long, seq long, ticked long", "append", GroupStateTimeout.NoTimeout
    )


class Ledger:
    """Block reports of one node: last writer per chunk by seq, a full report is the truth as of its seq."""

    def __init__(self):
        self.incarnation, self.full, self.fresh = None, -1, True
        self.marks: dict[int, tuple[int, bool]] = {}
        self.held: set[int] = set()

    def report(self, incarnation: str, seq: int, is_full: bool, added: list[int], deleted: list[int]) -> tuple[set[int], set[int]]:
        """What this report really added and removed."""
        if incarnation != self.incarnation:  # copies are kept until the first full report
            self.incarnation, self.full, self.marks = incarnation, -1, {}
        if seq <= self.full:
            return set(), set()
        before = set(self.held)
        if is_full:
            self.full = seq
            self.marks = {c: m for c, m in self.marks.items() if m[0] > seq}
            self.held = set(added) | {c for c, m in self.marks.items() if m[1]}
            self.held -= {c for c, m in self.marks.items() if not m[1]}
        else:
            for chunks, there in ((added, True), (deleted, False)):
                for c in chunks:
                    if c not in self.marks or self.marks[c][0] <= seq:
                        self.marks[c] = (seq, there)
                        (self.held.add if there else self.held.discard)(c)
        return self.held - before, before - self.held


def reconcile(reports: DataFrame) -> DataFrame:
    """Stream (node, seq, chunk, change) from a stream of reports (node, incarnation, seq, is_full, added, deleted, t), in order of arrival."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        led = Ledger()
        if state.exists:
            (text,) = state.get  # nested state goes as JSON
            led.incarnation, led.full, marks, held = json.loads(text)
            led.marks, led.held = {c: (seq, there) for c, seq, there in marks}, set(held)
        for batch in batches:
            out = []
            for r in batch.sort_values("t", kind="stable").itertuples(index=False):
                plus, minus = led.report(r.incarnation, r.seq, bool(r.is_full), list(r.added), list(r.deleted))
                out += [(key[0], r.seq, c, "added") for c in sorted(plus)] + [(key[0], r.seq, c, "removed") for c in sorted(minus)]
            yield pd.DataFrame(out, columns=["node", "seq", "chunk", "change"])
        state.update((json.dumps([led.incarnation, int(led.full), [[int(c), int(m[0]), m[1]] for c, m in led.marks.items()], sorted(map(int, led.held))]),))

    return reports.select("node", "incarnation", "seq", "is_full", "added", "deleted", "t").groupBy("node").applyInPandasWithState(
        step, "node long, seq long, chunk long, change string", "ledger string", "append", GroupStateTimeout.NoTimeout
    )


def windowed_latency(samples: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Stream of (window start, op, n, largest) over event time ``ts``; the watermark bounds state."""
    return samples.withWatermark("ts", late).groupBy(F.window("ts", width), "op").agg(F.count(F.lit(1)).alias("n"), F.max("latency_us").alias("largest")).select(F.col("window.start").alias("start"), "op", "n", "largest")

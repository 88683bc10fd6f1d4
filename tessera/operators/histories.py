"""Checks of client histories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify(ops: DataFrame) -> DataFrame:
    """``ops`` (kind, outcome) with class: failed reads and lists are dropped, other failures are ambiguous, and a put that found nothing is ambiguous too."""
    failed = ~F.col("outcome").isin("ok", "conflict", "notfound")
    c = F.when(F.col("outcome").isin("ok", "conflict"), F.col("outcome")).when(F.col("outcome") == "notfound", F.when(F.col("kind") == "put", "ambiguous").otherwise("notfound")).otherwise("ambiguous")
    return ops.filter(~(failed & F.col("kind").isin("get", "list"))).withColumn("class", c)


def violations(history: DataFrame) -> DataFrame:
    """(path, pos, kind, version, expected) of non-overlapping writes whose version is not the one after the last."""
    w = Window.partitionBy("path").orderBy("pos")
    h = history.withColumn("expected", F.coalesce(F.lag("version").over(w), F.lit(0)) + 1)
    return h.filter("version <> expected").select("path", "pos", "kind", "version", "expected")


def check_path(ops: list[tuple], most: int = 200_000) -> str:
    """ok, bad or unknown for one path: the search of Wing and Gong with Lowe's memory of seen configurations.

    ``ops``: (kind, call, end, outcome, version, hash); an ambiguous op ends never and may have had no effect.
    """
    ops = [o if o[3] != "ambiguous" else (o[0], o[1], float("inf"), *o[3:]) for o in sorted(ops, key=lambda o: (o[1], o[2]))]
    n = len(ops)
    must = sum(1 << i for i, o in enumerate(ops) if o[3] != "ambiguous")
    seen, stack = set(), [(0, (0, 0, None))]  # done as bits; (last version, live version, hash)
    while stack:
        done, state = stack.pop()
        if done & must == must:
            return "ok"
        if (done, state) in seen:
            continue
        seen.add((done, state))
        if len(seen) > most:
            return "unknown"
        first_end = min(o[2] for i, o in enumerate(ops) if not done >> i & 1)
        for i in range(n):
            o = ops[i]
            if done >> i & 1 or o[1] > first_end:
                continue
            kind, _, _, outcome, version, digest = o
            last, live, held = state
            if outcome == "ambiguous":
                stack.append((done | 1 << i, state))
            if kind == "put" and outcome in ("ok", "ambiguous"):
                if outcome == "ambiguous" or version == last + 1:
                    stack.append((done | 1 << i, (last + 1, last + 1, digest)))
            elif kind == "delete" and outcome in ("ok", "ambiguous"):
                if live and (outcome == "ambiguous" or version == last + 1):
                    stack.append((done | 1 << i, (last + 1, 0, None)))
            elif kind == "get" and outcome == "ok":
                if live and version == live and digest == held:
                    stack.append((done | 1 << i, state))
            elif outcome == "notfound":
                if not live:
                    stack.append((done | 1 << i, state))
            elif outcome == "conflict":
                stack.append((done | 1 << i, state))
    return "ok" if not must else "bad"


def linearizable(ops: DataFrame) -> DataFrame:
    """(path, verdict) of classified ops (path, kind, call, end, class, version, hash); paths are independent."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            got = [(p, check_path([(o["kind"], o["call"], o["end"], o["class"], o["version"], o["hash"]) for o in ops])) for p, ops in zip(batch["path"], batch["ops"], strict=True)]
            yield pd.DataFrame(got, columns=["path", "verdict"])

    cols = ["kind", "call", "end", "class", "version", "hash"]
    g = ops.groupBy("path").agg(F.collect_list(F.struct(*cols)).alias("ops"))  # the search over a path needs all of it
    return g.mapInPandas(run, f"path {ops.schema['path'].dataType.simpleString()}, verdict string")


def list_to_reads(lists: DataFrame, paths: DataFrame) -> DataFrame:
    """(op, path, present, version): a list of a prefix is a read of every path below it.

    Paths are matched by their namespace first, an equality join, and then by the
    prefix; a prefix without a whole namespace is matched with every namespace that begins so.
    """
    from tessera.operators.versions import namespace

    spaces = paths.select(namespace(F.col("path")).alias("ns")).distinct()
    want = lists.select("op", "prefix", "listed")
    deep = want.filter(F.locate("/", F.substring("prefix", 2, 1 << 30)) > 0).withColumn("ns", namespace(F.col("prefix")))
    flat = want.filter(F.locate("/", F.substring("prefix", 2, 1 << 30)) == 0)
    flat = flat.join(F.broadcast(spaces), F.concat(F.lit("/"), F.col("ns"), F.lit("/")).startswith(F.col("prefix")))  # namespaces of the key file: few
    cand = deep.unionByName(flat).join(paths.withColumn("ns", namespace(F.col("path"))), "ns").filter(F.col("path").startswith(F.col("prefix")))
    found = F.filter("listed", lambda x: x["path"] == F.col("path"))
    return cand.select("op", "path", (F.size(found) > 0).alias("present"), F.get(found, F.lit(0))["version"].alias("version"))

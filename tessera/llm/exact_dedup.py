"""Exact deduplication by two Bloom passes.

Pass 1 folds the digest of every text into a Bloom filter of two planes (hit
once, hit at least twice).  Pass 2 probes it: a text whose cells are not all hit
twice has no copy and passes straight through; only the others (true copies and
about 0.1 % false alarms) are shuffled, by digest, and decided exactly.

Scale: the planes take 4 bytes a document.  A filter covers at most ``SLAB``
documents (64 MB to broadcast); a larger corpus is probed in rounds over digest
ranges, each with its own filter, so what is broadcast never grows.  A group
that holds a large share of all rows is decided by a map-side-combined
aggregate and joined back by broadcast, with all
groups of at least a 1,024th of the rows (1,024 of them at most).

Defined cases: null text counts as empty, so nulls and empty texts form one
group.  Null ids never win against an id; if a group has only null ids, its rows
are all kept.  Rows that repeat both id and text all carry ``kept`` (the id
stays); ``dedup`` keeps one of them.  An empty table gives an empty result.
Extra columns are carried by ``dedup`` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Planes, arrow_map, build_planes, packed, row_slices, session_of, stash

#: Documents that one filter covers, and cells a document.
SLAB, CELLS = 1 << 24, 16
_UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def digests(texts: pa.Array) -> np.ndarray:
    """(n, 32) bytes: SHA-256 of each text after lower-casing A-Z only."""
    out = b"".join(hashlib.sha256((x.as_buffer().to_pybytes() if x.is_valid else b"").translate(_UPPER)).digest() for x in texts)
    return np.frombuffer(out, np.uint8).reshape(-1, 32)


def _words(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = d.view("<u8").astype(np.uint64)
    return w[:, 0], w[:, 1], w[:, 2]


def tag(docs: DataFrame, text: str = "text", slab: int = SLAB) -> tuple[DataFrame, int]:
    """``docs`` packed as (row, sha, suspect), and the number of rows."""
    spark, sc = session_of(docs), session_of(docs).sparkContext
    n = docs.count()
    rounds = max(1, -(-n // slab))
    size = max(64, CELLS * -(-n // rounds) // 8 * 8)
    texts = docs.select(F.col(text).alias("text"))
    rows, place = packed(docs, text)
    kind = T.StructType([rows.schema["row"], T.StructField("sha", T.BinaryType()), T.StructField("suspect", T.BooleanType())])

    def hashed(i):
        def f(batch):
            a, b, c = _words(digests(batch.column(0)))
            mine = c % np.uint64(rounds) == i
            return a[mine], b[mine]

        return f

    parts = []
    for i in range(rounds):
        planes = sc.broadcast(build_planes(texts, hashed(i), size).twice)

        def probe(it, planes=planes, i=i):
            for batch in (some for whole in it for some in row_slices(whole, place)):
                d = digests(batch.column(0).field(place))
                a, b, c = _words(d)
                mine = c % np.uint64(rounds) == i
                hit = Planes.hit(planes.value, size, a, b)
                got = pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(d), [None, pa.py_buffer(d.tobytes())]).cast(pa.binary()), pa.array(hit)], ["row", "sha", "suspect"])
                yield got if rounds == 1 else got.filter(pa.array(mine))

        parts.append(arrow_map(rows, probe, kind))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out, n


def annotate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slab: int = SLAB) -> DataFrame:
    """One row per row of ``docs``: row (all its columns), keep_id, group_size, kept, sha."""
    tagged, n = tag(docs, text, slab)
    key = F.col("row").getField(doc_id)
    groups = tagged.filter("suspect").groupBy("sha").agg(F.max(key).alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    groups = stash(groups, "copies")
    least = max(1000, n // 1024)
    hot, rest = groups.filter(F.col("group_size") >= least), groups.filter(F.col("group_size") < least)  # hot: at most 1,024 rows
    seen = tagged.join(F.broadcast(hot), "sha", "left")
    straight = seen.filter("not suspect or group_size is not null")
    shuffled = seen.filter("suspect and group_size is null").drop("keep_id", "group_size").join(rest, "sha", "left")
    both = straight.select("row", "sha", "keep_id", "group_size").unionByName(shuffled.select("row", "sha", "keep_id", "group_size"))
    return both.select(
        "row",
        F.when(F.col("group_size").isNull(), key).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(key.eqNullSafe(F.col("keep_id"))).alias("kept"),
        "sha",
    )


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slab: int = SLAB) -> DataFrame:
    """``docs`` without copies: of equal texts the row with the largest id stays, and one of its repetitions."""
    kept = annotate(docs, doc_id, text, slab).filter("kept")
    alone, shared = kept.filter("group_size = 1"), kept.filter("group_size > 1").dropDuplicates(["sha"])
    return alone.select("row.*").unionByName(shared.select("row.*"))

"""Connected components of a link table by alternating large and small stars, wholly in DataFrames.

Each round costs two aggregations and two joins over the links that are left;
rounds grow with the logarithm of the longest path.  Aggregates combine on the
map side, so a node with very many links costs no task more than its partial
results; joins on such a node are split by adaptive execution.

Up to ``FEW`` links, whatever the input, the driver labels them itself: the rounds
would be some ten stages each, whose plans and tasks cost it more memory than the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, session_of, stash

#: Most links that the driver takes, 16 bytes each.
FEW = 200_000


def label(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable), by lowering labels along links and then along labels until nothing changes."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, own = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while (own[a] != own[b]).any():
        least = np.minimum(own[a], own[b])
        for end in (own[a], own[b]):
            np.minimum.at(own, end, least)
        while (own[own] != own).any():
            own = own[own]
    return nodes, nodes[own]


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node reachable.

    Null ends and links of a node with itself are ignored; repeated links count once.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = stash(edges, "links")
    state = _state(edges)
    if 0 < state[0] <= FEW:
        table = edges.toArrow()
        found = label(*(table.column(x).to_numpy() for x in "uv"))
        discard(edges)
        kind = edges.schema["u"].dataType
        labels = session_of(edges).createDataFrame(pa.table(dict(zip(("node", "component"), map(pa.array, found), strict=True))))
        return stash(labels.select(F.col("node").cast(kind).alias("node"), F.col("component").cast(kind).alias("component")), "labels")
    while state[0]:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        lowest = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        old, large = edges, stash(both.join(lowest, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u")
        edges = stash(joined.select("u", F.col("m").alias("v")).unionAll(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "small")
        discard(old, large)
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))

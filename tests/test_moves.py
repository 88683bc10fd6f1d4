"""Rebalancing against a direct transcription of the reference's Plan, dispatch against whole rounds."""

import random

import pytest

from tessera.operators import repair


def plan(nodes, chunks, band, limit):
    """``nodes``: {node: (rack, used, target)}; ``chunks``: {id: (size, holders)}."""
    diff = {n: u - t for n, (_, u, t) in nodes.items()}
    if all(abs(x) <= band for x in diff.values()):
        return []
    rack, held, moves = {n: r for n, (r, _, _) in nodes.items()}, {i: set(h) for i, (_, h) in chunks.items()}, []

    def movable(i, s, d):
        if d in held[i]:
            return False
        others = {rack[h] for h in held[i] if h != s}
        return rack[s] == rack[d] or rack[s] in others or rack[d] not in others

    def pick():
        for s in sorted((n for n in diff if diff[n] > 0), key=lambda n: (-diff[n], n)):
            for d in sorted((n for n in diff if diff[n] < 0), key=lambda n: (diff[n], n)):
                ok = [(size, i) for i, (size, _) in chunks.items() if s in held[i] and size < diff[s] - diff[d] and movable(i, s, d)]
                fits = [(-size, i) for size, i in ok if size <= min(diff[s], -diff[d])]
                if ok:
                    return s, d, min(fits)[1] if fits else min(ok)[1]
        return None

    while len(moves) < limit and (m := pick()):
        s, d, i = m
        size = chunks[i][0]
        held[i] = held[i] - {s} | {d}
        diff[s] -= size
        diff[d] += size
        moves.append((len(moves), i, s, d, size))
    return moves


def run(spark, nodes, chunks, band, limit):
    t = spark.createDataFrame([(n, *x) for n, x in nodes.items()], "node long, rack long, used long, target long")
    h = spark.createDataFrame([(i, n, nodes[n][0], size) for i, (size, hs) in chunks.items() for n in hs], "id long, node long, rack long, size long")
    return sorted(map(tuple, repair.move_plan(t, h, band, limit).collect()))


def test_one_hot_node_others_within_band(spark):
    nodes = {1: (0, 130, 100), **{n: (n, 90, 100) for n in (2, 3, 4)}}
    chunks = {i: (10, [1]) for i in range(13)}
    got = run(spark, nodes, chunks, 20, 16)
    assert got == plan(nodes, chunks, 20, 16) and len(got) == 3


@pytest.mark.parametrize("seed", range(4))
def test_move_plan_equals_reference(spark, seed):
    rng = random.Random(seed)
    chunks = {i: (rng.randint(1, 30), rng.sample(range(7), 3)) for i in range(40)}
    used = {n: sum(size for size, h in chunks.values() if n in h) for n in range(7)}
    nodes = {n: (n % 3, used[n], sum(used.values()) // 7) for n in used}
    want = plan(nodes, chunks, 10, 12)
    assert want and run(spark, nodes, chunks, 10, 12) == want


@pytest.mark.parametrize("batch", [7, 10_000])
def test_dispatch_across_batches(spark, batch):
    rng = random.Random(3)
    queue = sorted((rng.randrange(2), rng.randrange(3), i, rng.randrange(6), rng.randrange(6, 12)) for i in range(200))
    want, waiting, number = [], list(queue), 0
    while waiting:
        s_used, t_used, took, rest = {}, {}, 0, []
        for item in waiting:
            c, _, i, s, t = item
            if c == waiting[0][0] and took < 8 and s_used.get(s, 0) < 2 and t_used.get(t, 0) < 2:
                s_used[s], t_used[t], took = s_used.get(s, 0) + 1, t_used.get(t, 0) + 1, took + 1
                want.append((number, i, s, t))
            else:
                rest.append(item)
        waiting, number = rest, number + 1
    q = spark.createDataFrame(queue, "class long, rank long, id long, source long, target long")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(batch))
    try:
        got = sorted(map(tuple, repair.dispatch(q).collect()))
    finally:
        spark.conf.set(key, before)
    assert got == sorted(want)

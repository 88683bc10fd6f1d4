"""Operators on small tables with known answers, edge cases first."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import chunks, cluster, erasure, histories, oplog, repair, reports, versions
from tessera.sources import stores
from tessera.streaming.stateful import Detector, Ledger


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def files(spark, *texts):
    return spark.createDataFrame([(f"/n/{i}", "n", bytes(t), len(t)) for i, t in enumerate(texts)], "path string, ns string, content binary, size long")


def test_chunk_scan_edges(spark):
    f = files(spark, b"", b"abcd", b"abcde")
    got = rows(chunks.chunk_scan(f, 4).select("path", "idx", "size"))
    assert got == [("/n/1", 0, 4), ("/n/2", 0, 4), ("/n/2", 1, 1)]
    assert rows(chunks.chunk_counts(f, 4)) == [("/n/0", 0, 0), ("/n/1", 1, 4), ("/n/2", 2, 1)]


def test_dedup_ratio_of_edited_copies(spark):
    """A base of five chunks and ten copies with one edited each: 11 x 5 referenced, 15 distinct, 3.67 times."""
    refs = [(f"{i}" if i != k % 5 or k < 0 else f"e{k}", 4) for k in range(-1, 10) for i in range(5)]
    got = chunks.dedup_summary(spark.createDataFrame(refs, "id string, size long")).first()
    assert (got.referenced_bytes, got.unique_bytes, round(got.referenced_bytes / got.unique_bytes, 2)) == (220, 60, 3.67)


def test_dedup_of_nothing(spark):
    got = chunks.dedup_summary(spark.createDataFrame([], "id string, size long")).first()
    assert tuple(got) == (0, 0, 0, 0)


def test_drift_reports_planted_error_once(spark):
    a = spark.createDataFrame([(1, 2), (2, 1)], "id long, refcount long")
    b = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id long, refcount long")
    assert rows(chunks.drift(a, b, "id", "refcount")) == [(1, 2, 1), (3, 0, 1)]


def test_scrub_finds_rot_and_unreadable(spark):
    f = files(spark, b"hello", b"x").select("path", F.lit(0).alias("idx"), F.sha2("content", 256).alias("id"), scalars.rot(F.col("content")).alias("data"))
    lost = f.limit(1).withColumn("data", F.lit(None).cast("binary"))
    assert chunks.scrub(f).count() == 2
    assert chunks.scrub(lost).count() == 1


def test_rot_flips_the_middle(spark):
    got = spark.createDataFrame([(b"abcd",), (b"",), (b"\x00",)], "c binary").select(scalars.rot(F.col("c")).alias("c")).collect()
    assert [bytes(r.c) for r in got] == [b"ab\x9cd", b"", b"\xff"]


VS = "path string, v long, size long, tombstone boolean, epoch long"


def test_tombstone_newest(spark):
    t = spark.createDataFrame([("a", 1, 5, False, 0), ("a", 2, 0, True, 1), ("b", 1, 7, False, 0)], VS)
    assert rows(versions.live(t).select("path", "v")) == [("b", 1)]
    assert rows(versions.deleted(t)) == [("a", 1, 5)]
    w = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("b", 0)], "path string, v long")
    assert rows(versions.lookup(t, w)) == [("a", 1, 5), ("b", 1, 7)]


def test_retention_and_lease_boundaries(spark):
    t = spark.createDataFrame([("a", 1, 5, False, 0), ("a", 2, 5, False, 3)], VS)
    assert rows(versions.sweep(t, 2, 4)) == []
    assert rows(versions.sweep(t, 2, 5)) == [("a", 1, 3)]
    own = spark.createDataFrame([("a", 9)], "path string, epochs long")
    assert rows(versions.sweep(t, 2, 5, own)) == []
    u = spark.createDataFrame([("u", 1), ("u", 3)], "upload string, epoch long")
    assert rows(versions.expired_leases(u, 2, 4)) == []
    assert rows(versions.expired_leases(u, 2, 5)) == [("u", 3)]
    assert rows(versions.expired_leases(u, 0, 99)) == []


def test_quota_exact_and_over(spark):
    r = spark.createDataFrame([("a", 1, 10), ("a", 2, 1), ("b", 1, 99)], "ns string, seq long, size long")
    q = spark.createDataFrame([("a", 10), ("b", 0)], "ns string, quota long")
    assert rows(versions.quota_refusals(r, q)) == [("a", 2, 1, 10)]


def test_manifest_diff_vector(spark):
    mk = lambda s: spark.createDataFrame([("f", i, c, 4) for i, c in enumerate(s)], "path string, idx long, id string, size long")
    assert rows(versions.manifest_diff(mk("abcd"), mk("axcde"), ["path"])) == [("f", 3, 1, 1, 0, 12, 8)]


def test_resume_offset_gap(spark):
    c = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 3, "c")], "version long, idx long, id string")
    d = spark.createDataFrame([("a",), ("c",)], "id string")
    assert rows(versions.resume_offset(c, d)) == [(1, 2, 1)]


@pytest.mark.parametrize("path,ok", [("/a", True), ("/", False), ("a", False), ("/a/", False), ("/a//b", False), ("/a/../b", False), ("/a/./b", False), ("/a\0", False), ("/a/b.c", True), ("", False)])
def test_paths(spark, path, ok):
    assert spark.createDataFrame([(path,)], "p string").select(versions.valid_path(F.col("p"))).first()[0] is ok


def test_detector_vectors():
    """Times in ms, a tick every 500."""
    cases = [
        ([(t, None) for t in range(0, 30001, 1000)], 30000, []),
        ([(0, None), (2900, None), (5800, None)], 6000, []),
        ([(0, None)], 12000, [(3500, "suspect"), (10500, "dead")]),
        ([(0, None), (4200, None), (5200, None), (6200, None)], 7000, [(3500, "suspect"), (6200, "alive")]),
        ([(0, None), (3600, None), (4600, None), (7100, None), (8100, None), (9100, None)], 9500, [(3500, "suspect"), (9100, "alive")]),
        ([(0, None), (20000, None), (21000, None), (22000, None)], 22500, [(3500, "suspect"), (10500, "dead"), (20000, "suspect"), (22000, "alive")]),
    ]
    for beats, until, want in cases:
        d, out = Detector(), []
        events = sorted([(t, 1, i) for i, (t, _) in enumerate(beats)] + [(t, 0, 0) for t in range(500, until + 1, 500)])
        for t, is_beat, seq in events:
            got = d.beat(t, seq) if is_beat else d.tick(t)
            out += got
        assert [x for x in out if x[1] != "alive" or x[0] > 0] == want


def test_detector_batch_restart_and_order(spark):
    b = spark.createDataFrame([(1, 1, 0, False), (1, 2, 1000, False), (1, 3, 1500, True), (1, 4, 2500, False), (1, 5, 3500, False)], "node long, seq long, t long, restarted boolean")
    assert [r.state for r in cluster.detector(b, 1500, 3000).orderBy("t").collect()] == ["alive", "alive", "suspect", "suspect", "alive"]


def test_full_report_overtaken(spark):
    r = spark.createDataFrame([(1, 7, "add", 1, True), (1, 8, "add", 1, True), (1, 7, "delete", 3, False), (1, 9, "add", 2, False), (1, 9, "delete", 2, False), (1, 5, "add", 0, False)], "node long, chunk long, action string, seq long, is_full boolean")
    assert rows(cluster.reconcile_reports(r)) == [(1, 8)]


def test_ledger_matches_batch(spark):
    rng = random.Random(4)
    for _ in range(20):
        led, out = Ledger(), []
        seqs = list(range(1, 12))
        rng.shuffle(seqs)
        for seq in seqs:
            full = rng.random() < 0.2
            added, deleted = [rng.randrange(6) for _ in range(3)], [] if full else [rng.randrange(6)]
            out += [(1, c, "add", seq, full) for c in added] + [(1, c, "delete", seq, full) for c in deleted] + ([(1, 99, "add", seq, True)] if full else [])
            led.report("i", seq, full, added + ([99] if full else []), deleted)
        got = {r.chunk for r in cluster.reconcile_reports(spark.createDataFrame(out, "node long, chunk long, action string, seq long, is_full boolean")).collect()}
        assert got == led.held


def test_stripe_states(spark):
    sh = spark.createDataFrame([(s, i, s * 6 + i) for s in range(4) for i in range(6)], "stripe long, slot long, id long")
    alive = {0: [1] * 6, 1: [0, 0, 0, 1, 1, 1], 2: [1, 1, 1, 1, 0, 1], 3: [2] + [1] * 5}
    c = spark.createDataFrame([(s * 6 + i, a, a) for s, x in alive.items() for i, a in enumerate(x)], "id long, alive long, readable long")
    assert {r.stripe: r.state for r in cluster.stripe_health(sh, c).collect()} == {0: "ok", 1: "lost", 2: "under", 3: "over"}


def test_nearest_rank_edges(spark):
    for n, want in ((1, (0, 0)), (2, (1, 1)), (100, (50, 95))):
        d = spark.createDataFrame([("a", i) for i in range(n)], "k string, x long")
        r = reports.nearest_rank(d, ["k"], "x", [50, 95]).first()
        assert (r.p50, r.p95) == want
    assert reports.nearest_rank(spark.createDataFrame([], "k string, x long"), ["k"], "x", [50]).count() == 0


def test_erasure_all_losses():
    rng = random.Random(1)
    for n in (1, 3, 4, 5, 1000):
        data = rng.randbytes(n)
        s = dict(enumerate(erasure.encode(data)))
        for lost in itertools.combinations(range(6), 2):
            left = {k: v for k, v in s.items() if k not in lost}
            assert erasure.decode(left, n) == data
            assert erasure.rebuild(left, lost[0]) == s[lost[0]]
    with pytest.raises(ValueError):
        erasure.encode(b"")
    with pytest.raises(ValueError):
        erasure.decode({0: b"", 1: b"", 2: b""}, 1)


def test_wal_truncation(spark):
    w = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 1, 1), (4, 2, 2)], "save long, first long, index long")
    assert rows(oplog.effective(w).select("save")) == [(1,), (3,), (4,)]


def op(i, kind, **k):
    base = {"log_index": i, "op": kind, "request": f"r{i}", "path": "/n/a", "ns": "n", "expected": -1, "upload": 0, "idx": 0, "id": "x", "n_chunks": 1, "size": 5, "version": 0, "epochs": 0}
    return tuple((base | k).values())


def test_fold(spark):
    log = [
        op(1, "begin", request="q", expected=0), op(2, "begin", request="q"), op(3, "commit", upload=1), op(4, "claim", upload=1), op(5, "claim", upload=1, id="y"), op(6, "commit", upload=1),
        op(7, "begin", expected=0), op(8, "delete", expected=9), op(9, "delete", expected=1), op(10, "delete", expected=0), op(11, "undelete"), op(12, "begin", size=6), op(13, "begin", size=5), op(14, "abort", upload=2), op(15, "epoch"),
    ]
    df = spark.createDataFrame(log, oplog.OPS)
    got = {r.log_index: (r.accepted, r.reason) for r in oplog.fold(df, {"n": 10}).collect()}
    want = {1: (True, ""), 2: (True, "repeated"), 3: (False, "unclaimed"), 4: (True, ""), 5: (False, "mismatch"), 6: (True, ""), 7: (False, "conflict"), 8: (False, "conflict"), 9: (True, ""), 10: (False, "not found"), 11: (True, ""), 12: (False, "quota"), 13: (True, ""), 14: (True, ""), 15: (True, "")}
    assert got == want
    v = oplog.accepted_versions(df, oplog.fold(df, {"n": 10}))
    assert sorted((r.v, r.tombstone) for r in v.collect()) == [(1, False), (2, True), (3, False)]


def test_linearizability():
    put = lambda c, e, v, o="ok", h="h": ("put", c, e, o, v, h)
    assert histories.check_path([put(0, 1, 1), put(2, 3, 2)]) == "ok"
    assert histories.check_path([put(0, 1, 1), put(2, 3, 3)]) == "bad"
    assert histories.check_path([put(0, 5, 2), put(1, 4, 1)]) == "ok"
    assert histories.check_path([put(0, 1, 1), put(2, 3, 0, "ambiguous"), ("get", 4, 5, "ok", 2, "h")]) == "ok"
    assert histories.check_path([put(0, 1, 1), ("get", 2, 3, "notfound", 0, None)]) == "bad"
    assert histories.check_path([]) == "ok"


def test_placement_spreads_racks(spark):
    n = spark.createDataFrame([(i, i % 3, 0, True, False, "active") for i in range(6)], "node long, rack long, used long, alive boolean, slow boolean, admin string")
    c = spark.createDataFrame([(i, 10) for i in range(20)], "id long, size long")
    got = repair.place(c, n).join(n.select("node", "rack"), "node")
    per = got.groupBy("id").agg(F.countDistinct("node").alias("n"), F.countDistinct("rack").alias("r")).collect()
    assert all((r.n, r.r) == (3, 3) for r in per)
    loads = [r.k for r in got.groupBy("node").agg(F.count(F.lit(1)).alias("k")).collect()]
    assert max(loads) - min(loads) <= 1


def test_move_plan_improves_balance(spark):
    t = spark.createDataFrame([(1, 0, 100, 50), (2, 1, 0, 50)], "node long, rack long, used long, target long")
    h = spark.createDataFrame([(i, 1, 0, 10) for i in range(10)], "id long, node long, rack long, size long")
    p = repair.move_plan(t, h, 5, 16).collect()
    assert [(r.source, r.destination) for r in p] == [(1, 2)] * 5


def test_token_bucket_and_ewma(spark):
    r = spark.createDataFrame([(1, 0, 1, 2), (1, 0, 2, 5), (1, 0, 3, 1), (1, 4_000_000, 4, 1)], "k long, t long, seq long, n long")
    assert [x.allowed for x in reports.token_bucket(r, "k", 1.0, 4.0).orderBy("seq").collect()] == [True, False, True, True]
    e = spark.createDataFrame([(1, 0, 1, 100), (1, 1, 2, 0), (1, 2, 3, 7)], "k long, t long, seq long, latency_us long")
    assert [x.score for x in reports.ewma(e, "k").orderBy("seq").collect()] == [100, 75, 58]


def test_evict_keeps_newest(spark):
    q = spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("c", 3, 5)], "name string, mtime long, size long")
    assert rows(chunks.evict(q, 10).select("name")) == [("b",), ("c",)]


def test_key_file(spark):
    k = spark.createDataFrame([("a", "h1", 1), ("a", "h2", 1), ("b", "h1", -1)], "ns string, hash string, quota long")
    assert {r.problem for r in stores.key_problems(k).collect()} == {"duplicate namespace", "duplicate key", "negative quota"}


def test_tables_and_snapshots(spark, tmp_path):
    (tmp_path / "t.csv").write_text("op,p50\nput,1.5\nget,bad\n")
    assert rows(stores.read_table(spark, str(tmp_path / "t.csv"), ["op"], ["p50"])) == [("get", 0.0), ("put", 1.5)]
    (tmp_path / "t.json").write_text('{"seed": 1, "scenario": "s", "untilMs": 5, "events": [{"seq": 1, "atMs": 2, "kind": "k", "node": "n", "text": "x"}], "reads": []}')
    assert stores.timeline(spark, str(tmp_path / "t.json")).first().atMs == 2
    stores.save_snapshot({"v": spark.range(3)}, str(tmp_path / "s"), 7)
    assert stores.load_snapshot(spark, str(tmp_path / "s"), 7, ["v"])["v"].count() == 3


def test_block_store(spark, tmp_path):
    import hashlib

    for data in (b"one", b"two"):
        h = hashlib.sha256(data).hexdigest()
        p = tmp_path / h[:2] / h[2:4]
        p.mkdir(parents=True)
        (p / h).write_bytes(data if data == b"one" else b"rotten")
    (tmp_path / "tmp.x").write_bytes(b"skip")
    assert sorted((r.size, r.ok) for r in stores.block_store(spark, str(tmp_path)).collect()) == [(3, True), (6, False)]


def test_list_to_reads(spark):
    paths = spark.createDataFrame([("/a/1",), ("/a/2",), ("/b/1",)], "path string")
    lists = spark.createDataFrame([(1, "/a/", [("/a/1", 3)]), (2, "/", [])], "op long, prefix string, listed array<struct<path:string,version:long>>")
    got = rows(histories.list_to_reads(lists, paths).select("op", "path", "present"))
    assert got == [(1, "/a/1", True), (1, "/a/2", False), (2, "/a/1", False), (2, "/a/2", False), (2, "/b/1", False)]

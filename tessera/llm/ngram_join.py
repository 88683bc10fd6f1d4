"""Set similarity self-join on word n-grams: rare-first prefix filter with length, positional and suffix filters.

1. One pass gives each document's set as (size, 128-bit class key) and counts its
   n-grams over all documents in two independent rows of counters, of which the
   smaller counts.  Documents with equal sets are one class from here on, and the
   row with the smallest id stands for it.
2. N-grams of a set are ordered by (count, hash), rarest first; any total order is
   exact.  A pair with similarity t or more shares an n-gram among the first
   n - ceil(t n) + 1 of both.  A set of so few n-grams that any change takes it
   below t has no partner but equal sets.
3. Rows (n-gram, class, size, position) are shuffled by n-gram; n-grams of one class
   go.  Within an n-gram and size band, every class is tried against the most
   central one (length and positional filter); of these partners each class keeps
   the one with most common prefix n-grams.  Verified links give components.
4. N-grams whose classes lie in different components still may hide links: pairs
   across components that pass the length, positional and suffix filters are
   verified, once each, the nearest of each class first.  The suffix filter cuts both sets in equal hash ranges; the
   differences of the ranges' counts bound the symmetric difference.  Pairs inside
   a component are never made, so a large family of near copies costs links, not
   pairs; n-grams of many classes are compared block by block.
5. Verification intersects the sets in full.

Scale: what is broadcast is the counter table and Bloom planes, both of fixed
largest size.  Texts are never shuffled; only sets of classes that have a
candidate are.

Defined cases: null, empty and all-space texts have size 0, are linked with
nothing and are their own component; rows that share an id count as one document;
rows with a null id have a null component; an empty table gives an empty result.
Hashes are 64 bits wide: two different n-grams of a pair are taken for one with
probability below 1e-13.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Planes, arrow_map, attach_groups, build_planes, discard, mix64, session_of, ship, slices, stash
from tessera.llm.components import components
from tessera.llm.shingles import shingle_sets

#: Counters in each of two rows, as a power of two: 4 MB to broadcast.
COUNTER_BITS = 19
#: Largest number of Bloom cells: 8 MB to broadcast.
MOST_CELLS = 1 << 26
#: Classes in a block of a hot n-gram; pairs that a task holds to make each once; classes (16 bytes each) that may be broadcast.
BLOCK, HELD, FEW = 2000, 100_000, 100_000


def class_key(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


class Threshold:
    """Jaccard similarity of at least ``percent`` in a hundred, in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def prefix(self, n):
        return n + 1 + (-self.percent * n) // 100  # n - ceil(n percent / 100) + 1

    def overlap(self, a, b):
        return -(-self.percent * (a + b) // (100 + self.percent))

    @property
    def least(self) -> int:
        """Smallest size at which a set can have a partner that differs."""
        n = 1
        while 100 * n < self.percent * (n + 1):
            n += 1
        return n


def _cells(s: np.ndarray) -> list[np.ndarray]:
    """The counter of each n-gram in each row of counters."""
    return [(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), (mix64(s) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]


def signatures(docs: DataFrame, width: int, doc_id: str, text: str, fan: int = 16) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, c1, c2) per row, and the counters of all n-grams of all rows: partial ones of each task are merged in ``fan`` tasks, then on the driver."""
    size = 1 << COUNTER_BITS

    def run(it):
        counts, some_rows = np.zeros((2, size), np.uint32), False
        for batch in it:
            for some in slices(batch, 1):
                sets = shingle_sets(some.column(1), width)
                if sets:
                    for row, cell in zip(counts, _cells(np.concatenate(sets)), strict=True):
                        row += np.bincount(cell, minlength=size).astype(np.uint32)
                keys, some_rows = [class_key(s) for s in sets], True
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.nulls(len(sets), pa.binary())],
                    ["doc_id", "n", "c1", "c2", "counts"],
                )
        if some_rows:
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([counts.tobytes()], pa.binary())], ["doc_id", "n", "c1", "c2", "counts"])

    def merge(it):
        total = np.zeros(2 * size, np.int64)
        for batch in it:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()], pa.binary())], ["counts"])

    both = stash(arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, n long, c1 long, c2 long, counts binary"), "signatures")
    total = np.zeros(2 * size, np.int64)
    for row in arrow_map(both.filter("counts is not null").select("counts").repartition(fan), merge, "counts binary").toLocalIterator():
        total += np.frombuffer(row.counts, np.uint32)
    rows = both.filter("counts is null").select("doc_id", "n", "c1", "c2")
    rows.stashed_at = both.stashed_at
    return rows, np.minimum(total, (1 << 32) - 1).astype(np.uint32).reshape(2, size)


def _id_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    x = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return mix64(x), mix64(x + np.uint64(1))


class Ids:
    """A broadcast Bloom filter of ids; of the rows it lets pass too many, none is wanted and none is wrong."""

    def __init__(self, ids: DataFrame):
        self.size = min(MOST_CELLS, max(64, 16 * ids.count() // 8 * 8))
        self.plane = session_of(ids).sparkContext.broadcast(build_planes(ids, lambda b: _id_hashes(b.column(0)), self.size).once)

    def of(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The rows of ``batch`` whose first column may be among the ids."""
        hit = Planes.hit(self.plane.value, self.size, *_id_hashes(batch.column(0)))
        return batch.filter(pa.array(hit & batch.column(0).is_valid().to_numpy(zero_copy_only=False)))


def _gram_hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    h = batch.column(0).to_numpy().view(np.uint64)
    return mix64(h), mix64(h + np.uint64(1))


def prefixes(docs: DataFrame, counts: Broadcast, width: int, limit: Threshold, reps: Ids, doc_id: str, text: str, only: tuple[Broadcast, int] | None = None) -> DataFrame:
    """(h, rep, n, pos): the rarest n-grams of each set, for rows that may stand for their class; with ``only``, those that a Bloom filter of so many cells lets pass."""
    least = limit.least

    def run(it):
        for batch in it:
            for some in slices(reps.of(batch), 1):
                hs, reps_, ns, ps = [], [], [], []
                for i, s in zip(some.column(0).to_pylist(), shingle_sets(some.column(1), width), strict=True):
                    if len(s) < least:
                        continue
                    p = limit.prefix(len(s))
                    often = np.minimum(*(row[cell] for row, cell in zip(counts.value, _cells(s), strict=True)))
                    order = np.lexsort((s, often))[:p]
                    hs.append(s[order].view(np.int64))
                    reps_.append(np.full(p, i))
                    ns.append(np.full(p, len(s)))
                    ps.append(np.arange(p))
                if hs:
                    got = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in ((hs, np.int64), (reps_, np.int64), (ns, np.int32), (ps, np.int32))], ["h", "rep", "n", "pos"])
                    yield got.filter(pa.array(Planes.hit(only[0].value, only[1], *_gram_hashes(got)))) if only else got

    return arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "h long, rep long, n int, pos int")


def _ranges(s: np.ndarray, each: int) -> bytes:
    """How many n-grams of a set fall in each of 2 ** k hash ranges, about ``each`` (a power of two) a range, at least 16 ranges and at most 1,024.

    Counts are kept modulo 16, half a byte each: the distance on that circle is
    never more than the true difference, so the bound holds.
    """
    bits = min(10, max(4, len(s).bit_length() - each.bit_length()))
    c = (np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 15).astype(np.uint8)
    return (c[::2] << 4 | c[1::2]).tobytes()


class Ranges:
    """Range counts of the classes of a group, by width; neighbouring ranges add up to one of half the width."""

    def __init__(self, blobs: list[bytes]):
        size = np.array([len(x) for x in blobs])
        self.of, self.at, self.tables = size, np.zeros(len(blobs), np.int64), {}
        for n in np.unique(size).tolist():
            own = np.flatnonzero(size == n)
            self.at[own] = np.arange(len(own))
            raw = np.frombuffer(b"".join(blobs[i] for i in own), np.uint8).reshape(len(own), n)
            self.tables[n] = np.stack([raw >> 4, raw & 15], axis=2).reshape(len(own), 2 * n).astype(np.int16)

    def apart(self, k: int, near: np.ndarray) -> np.ndarray:
        """Least possible symmetric difference of class ``k`` and each of ``near``."""
        out, own = np.zeros(len(near), np.int64), self.tables[self.of[k]][self.at[k]]
        for n in np.unique(self.of[near]).tolist():
            some = self.of[near] == n
            a, b = self.tables[n][self.at[near[some]]], own
            while a.shape[1] > len(b):
                a = a.reshape(len(a), -1, 2).sum(axis=2)
            while len(b) > a.shape[1]:
                b = b.reshape(-1, 2).sum(axis=1)
            far = (a - b) & 15
            out[some] = np.minimum(far, 16 - far).sum(axis=1)
        return out


def class_ranges(docs: DataFrame, wanted: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """(rep, n, coarse, fine) of the rows whose ids are in ``wanted``: range counts of their sets."""
    ids = Ids(wanted)

    def run(it):
        for batch in it:
            for some in slices(ids.of(batch), 1):
                sets = shingle_sets(some.column(1), width)
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0), sizes, *(pa.array([_ranges(s, each) for s in sets], pa.binary()) for each in (16, 4))], ["rep", "n", "coarse", "fine"])

    return stash(arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "rep long, n long, coarse binary, fine binary"), "ranges")


def near(pairs: DataFrame, ranges: DataFrame, limit: Threshold) -> DataFrame:
    """The pairs (a, b) that the fine suffix filter lets pass, with ``apart``: the least possible symmetric difference."""
    side = lambda x: ranges.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("fine").alias(f"fine_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def run(it):
        for batch in it:
            for some in slices(batch, 4):
                na, nb = (some.column(i).to_numpy() for i in (2, 3))
                if not len(na):
                    continue
                table = Ranges([x.as_py() for x in some.column(4)] + [x.as_py() for x in some.column(5)])
                apart = np.array([table.apart(i, np.array([len(na) + i]))[0] for i in range(len(na))], np.int64)
                ok = apart <= na + nb - 2 * limit.overlap(na, nb)
                yield pa.RecordBatch.from_arrays([*some.columns[:2], pa.array(apart)], ["a", "b", "apart"]).filter(pa.array(ok))

    return arrow_map(both.select("a", "b", "n_a", "n_b", "fine_a", "fine_b"), run, "a long, b long, apart long")


def verify(docs: DataFrame, pairs: DataFrame, width: int, limit: Threshold, doc_id: str, text: str) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough.

    Only sets of documents in a pair move, as sorted n-grams of 64 bits; texts do not.
    """
    pairs = stash(pairs.select("a", "b").distinct(), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    ids = Ids(stash(ends, "ends"))

    def emit(it):
        for batch in it:
            for some in slices(ids.of(batch), 1):
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([s.tobytes() for s in shingle_sets(some.column(1), width)], pa.binary())], ["rep", "set"])

    sets = stash(arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), emit, "rep long, set binary"), "sets", codec="none")
    few = pairs.count() <= FEW

    def side(x: str) -> DataFrame:
        """(a, b, set) of one end; the pairs go by broadcast if they are few, so that a set moves once a pair."""
        return sets.select(F.col("rep").alias(x), "set").join(F.broadcast(pairs) if few else pairs, x).select("a", "b", "set")

    # a side of a pair is a row; equal ids with several texts make several rows of it, any of which may do
    both = side("a").withColumn("at", F.lit(0)).unionAll(side("b").withColumn("at", F.lit(1)))
    both = both.groupBy("a", "b").agg(F.collect_list(F.struct("at", "set")).alias("sets"))
    cuts = (np.arange(1, 16, dtype=np.uint64) << np.uint64(60)).astype(np.uint64)

    def similar(a: np.ndarray, b: np.ndarray) -> bool:
        need = limit.overlap(len(a), len(b))
        if not need or need > min(len(a), len(b)):
            return False
        ca, cb = (np.diff(np.concatenate([[0], np.searchsorted(x, cuts), [len(x)]])) for x in (a, b))
        if np.abs(ca - cb).sum() > len(a) + len(b) - 2 * need:
            return False
        at = np.searchsorted(a, b)
        return int((a[np.minimum(at, len(a) - 1)] == b).sum()) >= need

    def check(it):
        for batch in it:
            ok = []
            for found in batch.column(2):
                own = {0: set(), 1: set()}
                for x in found:
                    own[x["at"].as_py()].add(x["set"].as_py())
                ok.append(any(similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x in own[0] for y in own[1]))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    out = stash(arrow_map(both, check, "a long, b long"), "verified")
    discard(sets)
    return out


def across(rows: DataFrame, limit: Threshold) -> DataFrame:
    """Pairs (a, b) of different components that share an n-gram and pass the length, positional and coarse suffix filters, once each.

    ``rows``: (h, rep, n, pos, component, coarse).  A task makes a pair once
    among HELD pairs, and a distinct follows.  N-grams of more than BLOCK classes are dealt in pairs of
    blocks, so no task holds more than two blocks of classes.
    """
    sizes = rows.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")  # few: each has BLOCK rows
    dealt = rows.join(F.broadcast(sizes) if sizes.count() <= FEW else sizes, "h", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    parts = int(session_of(rows).conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("h", "i", "j", "own", "n", "rep", "pos", "component", "coarse")
    dealt = dealt.repartition(parts, "h", "i", "j").sortWithinPartitions("h", "i", "j", "n")

    def compare(group: list[tuple], h: int, i: int, j: int):
        own, n, rep, pos, comp = (np.array([x[k] for x in group]) for k in range(5))
        ranges = Ranges([x[5] for x in group])
        for k in range(1, len(group)):  # sorted by n: partners before k are no larger
            lo = int(np.searchsorted(n, -(-limit.percent * n[k] // 100)))
            if lo >= k:
                continue
            need = limit.overlap(n[lo:k], n[k])
            ok = (comp[lo:k] != comp[k]) & (np.minimum(n[lo:k] - pos[lo:k], n[k] - pos[k]) >= need)
            if i != j:
                ok &= own[lo:k] != own[k]
            close = lo + np.flatnonzero(ok)
            if len(close):  # suffix filter
                close = close[ranges.apart(k, close) <= n[close] + n[k] - 2 * limit.overlap(n[close], n[k])]
            for m in close.tolist():
                yield (rep[m], rep[k]) if rep[m] < rep[k] else (rep[k], rep[m])

    def groups(it):
        group, last = [], None
        for batch in it:
            for h, i, j, *row in zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True):
                if (h, i, j) != last:
                    if len(group) > 1:
                        yield from compare(group, *last)
                    group, last = [], (h, i, j)
                group.append(row)
        if len(group) > 1:
            yield from compare(group, *last)

    def run(it):
        made = set()
        for pair in groups(it):
            made.add(pair)
            if len(made) >= HELD:
                yield _pairs(list(made))
                made = set()
        if made:
            yield _pairs(list(made))

    return arrow_map(dealt, run, "a long, b long").distinct()


def _pairs(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], ["a", "b"])


def similarity_classes(docs: DataFrame, width: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, n_copies (rows with an equal set)."""
    limit = Threshold(percent)
    of = (width, limit, doc_id, text)
    rows, counts = signatures(docs, width, doc_id, text)
    total = rows.count()
    classes = stash(rows.filter("n > 0 and doc_id is not null").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.max("n").alias("n")), "classes")
    reps = stash(classes.filter(F.col("n") >= limit.least).select("rep").distinct(), "reps")

    index = partial(prefixes, docs, session_of(docs).sparkContext.broadcast(counts), width, limit, Ids(reps), doc_id, text)
    # an n-gram of one class only links nothing; copies that the filter of ids let pass go in ``_members``
    groups = stash(index().groupBy("h").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "ngrams")
    members = _members(index, groups, reps)
    shared = _with_company(members, percent)
    discard(groups, members, reps)
    ranges = class_ranges(docs, stash(shared.select("rep").distinct(), "wanted"), width, doc_id, text)

    # central classes, of whose prefix most n-grams are shared, are tried first: the least edited text of a family links most others
    central = stash(shared.groupBy("rep").agg(F.count(F.lit(1)).alias("central")), "central")
    led = shared.join(central, "rep")
    leaders = led.groupBy("h", "band").agg(F.max(F.struct("central", "n", "rep", "pos")).alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    leaders = stash(leaders, "leaders")
    tried = attach_groups(shared, leaders, ["h", "band"], "size", shared.count()).filter("first is not null and first.rep <> rep")
    need = F.ceil(F.lit(percent) * (F.col("n") + F.col("first.n")) / F.lit(100.0 + percent) - 1e-9)
    tried = tried.filter(F.least(F.col("n") - F.col("pos"), F.col("first.n") - F.col("first.pos")) >= need)
    best = tried.groupBy(F.col("rep").alias("b"), F.col("first.rep").alias("a")).agg(F.count(F.lit(1)).alias("common"), F.max("first.central").alias("central"))
    best = best.groupBy("b").agg(F.max(F.struct("common", "central", "a")).alias("best")).select(F.least("best.a", "b").alias("a"), F.greatest("best.a", "b").alias("b"))
    best = stash(best.distinct(), "tried")
    links = verify(docs, near(best, ranges, limit), *of)
    found = stash(components(links), "star_components")
    # from here on only classes in company count
    placed = shared.select("rep").distinct().join(found, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("component"))
    labelled = stash(shared.select("h", "rep", "n", "pos").join(placed.join(ranges.select("rep", F.col("n").cast("int").alias("n"), "coarse"), "rep"), ["rep", "n"]), "labelled")
    mixed = stash(labelled.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members")).filter("lo < hi").select("h", "members"), "mixed")
    of_mixed = attach_groups(labelled, mixed, ["h"], "members", labelled.count()).filter("members is not null").drop("members")
    pairs = across(of_mixed, limit).join(best, ["a", "b"], "left_anti")  # what was tried needs no second look
    pairs = stash(near(pairs, ranges, limit), "across")
    discard(leaders, central, labelled, mixed, shared)
    if not pairs.isEmpty():
        # the nearest partner of each class first: most other pairs are inside one component then
        nearest = pairs.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b")).select("a", "b")
        nearest = stash(nearest.unionByName(pairs.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a"))).distinct(), "nearest")
        links = stash(links.unionAll(verify(docs, nearest, *of)), "links")
        found = stash(components(links), "components")
        side = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
        apart = F.coalesce("of_a", "a") != F.coalesce("of_b", "b")
        rest = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").filter(apart).select("a", "b")
        rest = stash(rest.join(nearest, ["a", "b"], "left_anti"), "rest")
        if not rest.isEmpty():
            found = stash(components(links.unionAll(verify(docs, rest, *of))), "components")
        discard(nearest, rest)
    final = stash(classes.join(found, classes.rep == found.node, "left").select("c1", "c2", "n_copies", F.coalesce("component", "rep").alias("component_id")), "final")
    discard(best, pairs, ranges, classes, found, links)

    linked, alone = rows.filter("n > 0 and doc_id is not null"), rows.filter("n = 0 or doc_id is null")
    out = attach_groups(linked, final, ["c1", "c2"], "n_copies", total).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_copies")
    return out.unionByName(alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_copies")))


def without(docs: DataFrame, gone: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the ids in ``gone``: a Bloom filter lets the other rows pass without a shuffle, the rest are decided by a join.

    Only ids go to Python; the rows stay in the JVM.
    """
    n = gone.count()
    if not n:
        return docs
    ids = Ids(gone.select(F.col("doc_id").cast("long")))
    ship(session_of(docs))

    @F.arrow_udf("boolean")
    def maybe(x: pa.Array) -> pa.Array:
        return pa.array(Planes.hit(ids.plane.value, ids.size, *_id_hashes(x)))

    names = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.select(F.struct(*names).alias("row"), F.col(doc_id).cast("long").alias("id")).withColumn("maybe", maybe.asNondeterministic()("id"))
    decided = marked.filter("maybe").join(gone.select(F.col("doc_id").cast("long").alias("id")).distinct(), "id", "left_anti")
    return marked.filter("not maybe").select("row.*").unionByName(decided.select("row.*"))


def _with_company(shared: DataFrame, percent: int) -> DataFrame:
    """``shared`` with its size band, without rows to whose n-gram no other class of the same or a neighbouring band has.

    Sizes of a pair differ by less than a band, so such a row has no partner.
    """
    shared = shared.withColumn("band", F.floor(F.log(F.col("n")) / F.lit(float(np.log(100 / percent)))).cast("int"))
    counts = shared.groupBy("h", "band").agg(F.count(F.lit(1)).alias("own"))
    around = counts.select("h", F.explode(F.array(*[F.struct((F.col("band") + k).alias("band"), F.col("own").alias("all"), F.lit(k == 0).alias("here")) for k in (-1, 0, 1)])).alias("x"))
    around = around.groupBy("h", "x.band").agg(F.sum("x.all").alias("all"), F.sum(F.when(F.col("x.here"), F.col("x.all"))).alias("own")).filter("own is not null and all > 1")
    around = stash(around, "bands")
    total = around.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0]
    kept = attach_groups(shared, around.select("h", "band", "own"), ["h", "band"], "own", total).filter("own is not null")
    return stash(kept.select("h", "rep", "n", "pos", "band"), "company")


def _members(index: Callable[..., DataFrame], groups: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows of ``index`` (``prefixes`` of all but ``only``) whose n-gram is in ``groups`` and whose document stands for its class, once each.

    The worker that makes the rows drops those of other n-grams, and what is left is stored, as the join reads it twice.
    """
    counted = groups.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("members"), F.lit(0)).alias("rows")).first()
    size = min(MOST_CELLS, max(64, 16 * counted.n // 8 * 8))
    plane = session_of(groups).sparkContext.broadcast(build_planes(groups.select("h"), _gram_hashes, size).once)
    some = stash(index(only=(plane, size)), "prefixes")
    rows = attach_groups(some, groups, ["h"], "members", counted.rows).filter("members is not null")
    out = stash(rows.select("h", "rep", "n", "pos").join(reps, "rep", "left_semi").distinct(), "shared")
    discard(some)
    return out

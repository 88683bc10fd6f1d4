"""Removal of repeated byte strings by suffix sorting with bucket-pointer refinement.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts in a
document with a smaller id.  All strings are judged on the input.

1. Anchors.  Every window of ``LENGTH`` bytes has one anchor: its ``K``-gram of
   smallest hash (leftmost on ties), so equal windows have equal anchors.  For
   each anchor its hash and the hash of its whole neighbourhood (all bytes of the
   windows it may anchor) are computed.  Within a batch of documents equal
   neighbourhoods are one entry, that of the smallest id; the others are repeats
   already.  Entries are shuffled as packed arrays by anchor hash.
2. An entry with the neighbourhood of a smaller id is a repeat as a whole.  What
   else shares its anchor with another neighbourhood is open, if it shares the
   bytes before or behind the anchor too: each window has at least half of REACH
   of one or the other.  Only some of its windows may repeat.  An entry that
   shares neither with another document is done.
3. Open neighbourhoods (the edges of repeated passages) are cut out of the texts
   and suffix-sorted together with all others of their anchor by bucket-pointer
   refinement: buckets of 8-grams are refined by sorting on the bucket of the
   suffix 8, then 16, then 18 bytes on, each time with the buckets of the round
   before; the last buckets hold equal strings of exactly 50 bytes.  All but those of
   the smallest id repeat.
4. The spans of each document meet its text once more.

Skew: entries are combined before the shuffle, so an anchor of a third of all
documents sends one entry a batch and neighbourhood.  An anchor with more than
``HOT`` open neighbourhoods is compared window by window: its windows are
dealt by their own hash, combined per batch in the same way, and need no sorting by suffixes.  Texts are shuffled
only for documents that have something to compare or to remove; a Bloom filter of at most
8 MB lets the others pass.

Neighbourhoods are compared by 64-bit hashes within an anchor (an error has
probability below 1e-12 per repeated anchor); step 3 compares bytes.

Defined cases: null text counts as empty; texts below ``LENGTH`` bytes keep all;
equal ids are one document (none is smaller); a null id neither removes nor loses
anything; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Planes, arrow_map, build_planes, flat_bytes, mix64, session_of, slices, stash

LENGTH, K = 50, 16
REACH = LENGTH - K  # bytes of a window before or behind its anchor
ENTRIES, HOT, STRINGS = 400_000, 12_000, 4_000
#: Parts of ``STRINGS`` strings that travel as one, so that rows on the way do not multiply with tasks and parts; bytes of strings dealt at once.
TOGETHER, SENT = 16, 1 << 24
MOST_CELLS = 1 << 26
#: Bytes hashed at once, of one text at once, and combined before entries are sent.
SLICE, RUN, FLUSH = 1 << 20, 1 << 22, 1 << 23

_VALUE = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64)))]
    return _powers[0], _powers[1]


class Hasher:
    """Hashes of any substring of ``data``, by prefix sums modulo 2 ** 64."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(max(len(data) + 1, SLICE))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * up[: len(data)])])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place in the flat data, text, anchor hash, neighbourhood hash, sides) of all anchors of all texts; fewer than 16 MB at once.

    ``sides``: 16 bits of the hash of the REACH // 2 bytes before the anchor, and of those behind it; 0 where a text has fewer.
    """
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2 + (np.zeros((2, 0), np.uint16),)
    h, at = Hasher(data), np.arange(n - K + 1)
    gram = h(at, at + K)
    order = (gram & ~np.uint64((1 << 24) - 1)) | at.astype(np.uint64)
    w, low, span = REACH + 1, order, 1
    while span < w:  # minima over runs of w, by doubling
        step = min(span, w - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    sizes = np.diff(offsets)
    of_byte = np.repeat(np.arange(len(sizes)), sizes)
    first = np.arange(n - LENGTH + 1)
    inside = of_byte[first] == of_byte[first + LENGTH - 1]
    place = (low[inside] & np.uint64((1 << 24) - 1)).astype(np.int64)  # never falls from window to window
    place = place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place
    of = of_byte[place]
    start, stop = np.maximum(place - REACH, offsets[of]), np.minimum(place + LENGTH, offsets[of + 1])
    around = h(start, stop) ^ mix64((place - start).astype(np.uint64) + np.uint64(77))
    sides = np.zeros((2, len(place)), np.uint16)
    for side, a, b in ((0, place - REACH // 2, place), (1, place + K, place + K + REACH // 2)):
        whole = np.flatnonzero((a >= offsets[of]) & (b <= offsets[of + 1]))
        sides[side, whole] = h(a[whole], b[whole]) % np.uint64(65535) + np.uint64(1)
    return place, of, gram[place], around, sides


def refine(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bucket of the ``LENGTH`` bytes at each place: equal numbers for equal strings.

    ``ends``: for each place the end of its string, not read: a place nearer to it than
    LENGTH gets a bucket too, but no meaning: its grams run into the next string.
    All that another place is compared by lies within its own LENGTH bytes.
    """
    n = len(data)
    # initial buckets: 8-grams, read as big-endian numbers at each byte
    key = np.ndarray((n,), ">u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,)).astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    pointer = np.empty(n, np.int32)
    pointer[order] = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])[:n], dtype=np.int32)
    del key, order
    for offset in (8, 16, LENGTH - 32):
        # only buckets of several suffixes are refined; others keep their place
        size = np.bincount(pointer).astype(np.int32)
        live = np.flatnonzero(size[pointer] > 1)
        pair = pointer[live] * np.int64(n + 2)
        inside = live < n - offset
        pair[inside] += pointer[live[inside] + offset]
        order = np.argsort(pair)  # ties are one bucket, so their order is of no matter
        pair, live = pair[order], live[order]
        del order, inside
        fresh = np.concatenate([[True], pair[1:] != pair[:-1]])[: len(pair)]
        del pair
        own = pointer[live]
        head = np.concatenate([[True], own[1:] != own[:-1]])[: len(own)]
        del own
        # new pointer: the old bucket's first place plus the suffixes before the new bucket
        rank = np.arange(len(live), dtype=np.int32)
        inner = np.maximum.accumulate(np.where(fresh, rank, 0))
        inner -= np.maximum.accumulate(np.where(head, rank, 0))
        pointer = (np.cumsum(size, dtype=np.int32) - size + 1)[pointer]
        pointer[live] += inner
    return pointer


def _rows(part: np.ndarray, blobs: list[bytes], kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([kind] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ["part", "kind", "blob"])


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) * a.itemsize for a in arrays], np.int64)
    return np.array([len(arrays)], np.int64).tobytes() + head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _unpack(blob, kinds: tuple[str, ...]) -> list[np.ndarray]:
    raw = np.frombuffer(blob, np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    sizes, at, out = raw[8 : 8 + 8 * n].view(np.int64), 8 + 8 * n, []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(blob, np.dtype(kind), int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def text_key(texts: pa.Array) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(x.as_buffer()) if x.is_valid else 0 for x in texts], np.uint64).view(np.int64)


#: Result rows of steps 1 to 3: of document (doc_id, key), kind 1: spans (start, stop); kind 2: places of open anchors; kind 3: the same of hot ones.
FOUND = "doc_id long, key long, kind int, places binary"


def _found(doc: np.ndarray, key: np.ndarray, kind: int, places: np.ndarray) -> pa.RecordBatch:
    """One row per document; ``places`` (n, m) are grouped by it."""
    order = np.lexsort((places[:, 0], key, doc))
    doc, key, places = doc[order], key[order], places[order]
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(key) != 0)])) if len(doc) else np.zeros(0, np.int64)
    stop = np.append(cut[1:], len(doc))
    blobs = [np.ascontiguousarray(places[a:b].astype("<u4")).tobytes() for a, b in zip(cut, stop, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(doc[cut]), pa.array(key[cut]), pa.array([kind] * len(cut), pa.int32()), pa.array(blobs, pa.binary())], ["doc_id", "key", "kind", "places"])


def _first_of(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where a new group of equal keys begins in sorted order."""
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
    return new


def _alike(group: np.ndarray, side: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether an entry of another document has the same group and side; never where the side is 0."""
    order = np.lexsort((side, group))
    first = np.flatnonzero(_first_of(order, group, side))
    n = np.diff(np.append(first, len(order)))
    out = np.zeros(len(order), bool)
    if len(order):
        out[order] = np.repeat(np.minimum.reduceat(doc[order], first) < np.maximum.reduceat(doc[order], first), n)
    return out & (side != 0)


def _dealt(found: list[tuple], parts: int) -> pa.Table:
    """(part, blob) of found entries (doc, key, kind, two numbers), packed for ``parts`` groups of documents: rows do not multiply with the number of tasks."""
    out: dict[str, list] = {"part": [], "blob": []}
    found = [x for x in found if len(x[0])]
    if found:
        doc, key, kind, x, y = (np.concatenate(z) for z in zip(*found, strict=True))
        part = (mix64(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((x, kind, key, doc, part))
        cut = np.flatnonzero(_first_of(order, part))
        for i, j in zip(cut, np.append(cut[1:], len(order)), strict=True):
            o = order[i:j]
            out["part"].append(int(part[o[0]]))
            out["blob"].append(_pack(doc[o], key[o], kind[o], x[o], y[o]))
    return pa.table({"part": pa.array(out["part"], pa.int64()), "blob": pa.array(out["blob"], pa.binary())})


def _gather(table: pa.Table) -> pa.Table:
    """One row per document and kind."""
    packs = [_unpack(x, ("<i8", "<i8", "u1", "<u4", "<u4")) for x in table.column("blob").to_pylist()]
    doc, key, kind, x, y = (np.concatenate(z) for z in zip(*packs, strict=True))
    order = np.lexsort((x, kind, key, doc))
    cut = np.flatnonzero(_first_of(order, doc, key, kind))
    out: tuple[list, ...] = ([], [], [], [])
    for i, j in zip(cut, np.append(cut[1:], len(order)), strict=True):
        o = order[i:j]
        k = int(kind[o[0]])
        places = np.stack([x[o], y[o]], axis=1) if k == 1 else x[o]
        for column, value in zip(out, (int(doc[o[0]]), int(key[o[0]]), k, np.ascontiguousarray(places).tobytes()), strict=True):
            column.append(value)
    return pa.table({c: pa.array(v, t) for c, v, t in zip(("doc_id", "key", "kind", "places"), out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)})


def repeats(docs: DataFrame, parts: int) -> DataFrame:
    """Steps 1 and 2: FOUND rows."""

    def run(it):
        held, size = [], 0
        for batch in it:
            for some in slices(batch, 1, SLICE):
                data, offsets = flat_bytes(some.column(1))
                doc, key = some.column(0).to_numpy(zero_copy_only=False), text_key(some.column(1))
                for lo in [0] if len(data) <= RUN else range(0, max(1, len(data) - LENGTH + 1), RUN - LENGTH + 1):
                    # a longer text is taken in runs that overlap by a window
                    piece = data if len(data) <= RUN else data[lo : lo + RUN]
                    ends = offsets if len(data) <= RUN else np.array([0, len(piece)])
                    place, of, h, c, sides = anchors(piece, ends)
                    at = place - ends[of] + lo
                    # a neighbourhood cut by the end of a run equals no other, so its windows are compared one by one
                    cut = ((place < REACH) & (lo > 0)) | ((place + LENGTH > len(piece)) & (lo + len(piece) < len(data)) & (len(data) > RUN))
                    c = np.where(cut, mix64(key[of].view(np.uint64) ^ mix64(at.astype(np.uint64))), c)
                    span = np.stack([np.maximum(place - REACH, ends[of]), np.minimum(place + LENGTH, ends[of + 1])], axis=1) - ends[of][:, None] + lo
                    held.append((doc[of].astype(np.int64), key[of], h, c, at, span, *sides))
                    size += len(piece)
                    if size >= FLUSH:
                        yield from flush(held)
                        held, size = [], 0
        if held:
            yield from flush(held)

    def flush(held):
        doc, key, h, c, place, span, before, behind = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, c, h))
        new = _first_of(order, h, c)
        least = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else doc
        again = order[doc[order] > least]
        if len(again):
            got = _found(doc[again], key[again], 1, span[again])
            yield _rows(-1 - (got.column(0).to_numpy() % parts), [_pack(np.array([d], "<i8"), np.array([k], "<i8"), np.frombuffer(p.as_buffer(), np.uint8)) for d, k, p in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), got.column(3), strict=True)], 1)
        mine = order[doc[order] == least]
        # anchors with very many neighbourhoods are compared window by window later, wherever they stand
        fresh = _first_of(mine, h)
        group = np.cumsum(fresh) - 1
        hot = np.bincount(group)[group] > HOT if len(mine) else np.zeros(0, bool)
        if hot.any():
            some = mine[hot]
            got = _found(doc[some], key[some], 3, place[some][:, None])
            yield _rows(-1 - (got.column(0).to_numpy() % parts), [_pack(np.array([d], "<i8"), np.array([k], "<i8"), np.frombuffer(p.as_buffer(), np.uint8)) for d, k, p in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), got.column(3), strict=True)], 3)
        marks = mine[hot & fresh]
        sent = np.concatenate([mine[~hot], marks])
        flag = np.concatenate([np.zeros((~hot).sum(), np.uint8), np.ones(len(marks), np.uint8)])
        part = (h[sent] >> np.uint64(32)).astype(np.int64) % parts
        by = np.argsort(part, kind="stable")
        sent, flag, part = sent[by], flag[by], part[by]
        cut = np.flatnonzero(np.concatenate([[True], np.diff(part) != 0])) if len(part) else np.zeros(0, np.int64)
        for a, b in zip(cut, np.append(cut[1:], len(part)), strict=True):
            s = sent[a:b][np.lexsort((place[sent[a:b]], key[sent[a:b]], doc[sent[a:b]]))]
            f = flag[a:b][np.lexsort((place[sent[a:b]], key[sent[a:b]], doc[sent[a:b]]))]
            lead = _first_of(np.arange(len(s)), doc[s], key[s])
            p = place[s].astype("<u4")
            # columns apart, so that equal high halves and flags compress away
            yield _rows(part[a : a + 1], [_pack(doc[s][lead], key[s][lead], np.diff(np.append(np.flatnonzero(lead), len(s))).astype("<u4"), h[s].astype("<u4"), c[s], (p & 0xFFFF).astype("<u2"), (p >> 16).astype("<u2"), f, before[s].astype("<u2"), behind[s].astype("<u2"))], 0)

    sent = arrow_map(docs, run, "part long, kind int, blob binary")

    def reduce(table: pa.Table) -> pa.Table:
        found, packs = [], []

        def add(doc, key, kind, a, b):
            found.append((doc, key, np.full(len(doc), kind, "u1"), a.astype("<u4"), b.astype("<u4")))

        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
            if kind:
                d, k, p = _unpack(blob, ("<i8", "<i8", "<u4"))
                p = p.reshape(-1, 2) if kind == 1 else np.stack([p, p], axis=1)
                add(np.repeat(d, len(p)), np.repeat(k, len(p)), kind, p[:, 0], p[:, 1])
            else:
                packs.append(_unpack(blob, ("<i8", "<i8", "<u4", "<u4", "<u8", "<u2", "<u2", "u1", "<u2", "<u2")))
        if packs:
            doc = np.concatenate([np.repeat(p[0], p[2]) for p in packs])
            key = np.concatenate([np.repeat(p[1], p[2]) for p in packs])
            h, c, low, high, flag, *sides = (np.concatenate([p[i] for p in packs]) for i in range(3, 10))
            place = low.astype(np.int64) | high.astype(np.int64) << 16
            order = np.lexsort((doc, c, h))
            group = np.cumsum(_first_of(order, h)) - 1
            n = group[-1] + 1
            d = doc[order]
            lo, hi, marked = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min), np.zeros(n, bool)
            np.minimum.at(lo, group, d)
            np.maximum.at(hi, group, d)
            np.logical_or.at(marked, group, flag[order] == 1)
            new = _first_of(order, h, c)
            kinds = np.bincount(group, weights=new)
            least = d[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            whole = (d > least) & (flag[order] == 0)
            is_open = ~whole & ((lo < hi) | marked)[group] & ((kinds > 1) | marked)[group] & (flag[order] == 0)
            some = np.flatnonzero(is_open)
            alike = marked[group[some]]
            for side in sides:
                alike |= _alike(group[some], side[order[some]], d[some])
            is_open[some] = alike
            is_hot = is_open & ((np.bincount(group, weights=is_open) > HOT) | marked)[group]
            for kind, mask in ((4, whole), (2, is_open & ~is_hot), (3, is_hot)):
                some = order[mask]
                add(doc[some], key[some], kind, place[some], place[some])
        return _dealt(found, parts)

    return sent.groupBy("part").applyInArrow(reduce, "part long, blob binary").groupBy("part").applyInArrow(_gather, FOUND)


def _suspects(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with its key, and whether the Bloom filter of ``keys`` (doc_id, key) has it."""
    n = keys.count()
    size = min(MOST_CELLS, max(64, 16 * n // 8 * 8))

    def hashed(doc, key):
        return mix64(doc.view(np.uint64) ^ mix64(key.view(np.uint64))), mix64(key.view(np.uint64) + np.uint64(1))

    plane = session_of(docs).sparkContext.broadcast(build_planes(keys, lambda b: hashed(b.column(0).to_numpy(), b.column(1).to_numpy()), size).once)

    def run(it):
        for batch in it:
            doc = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            key = text_key(batch.column(1))
            hit = Planes.hit(plane.value, size, *hashed(doc, key)) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key), pa.array(hit)], ["doc_id", "text", "key", "hit"])

    return arrow_map(docs, run, "doc_id long, text string, key long, hit boolean")


def _deal(x: bytes) -> int:
    return zlib.crc32(x) * 0x9E3779B97F4A7C15 >> 20 & 0xFFFFFFFF


def open_spans(docs: DataFrame, opened: DataFrame, groups: int) -> DataFrame:
    """Step 3: FOUND rows of kind 1 from the open anchors (doc_id, key, kind, places)."""
    keys = stash(opened.select("doc_id", "key").distinct(), "open_keys")
    strings = F.length("places") / 4 * F.when(F.col("kind") == 3, REACH + 1).otherwise(1)
    n = opened.agg(F.coalesce(F.sum(strings), F.lit(0))).first()[0]
    if not n:
        return opened.filter("false")
    most, parts = STRINGS, max(1, int(n) // (STRINGS * TOGETHER))
    per_doc = opened.groupBy("doc_id", "key").agg(F.collect_list(F.struct("kind", "places")).alias("found"))  # as long as the document
    joined = _suspects(docs, keys).filter("hit").select("doc_id", "key", "text").dropDuplicates(["doc_id", "key"]).join(per_doc, ["doc_id", "key"])

    def cut(it):
        held: dict[int, list] = {}
        size = 0
        for batch in (some for whole in it for some in slices(whole, 2, FLUSH // 2)):
            wins: dict[bytes, tuple] = {}
            local: list[tuple[int, int, int]] = []
            for doc, key, text, found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode()
                for f in found:
                    for p in np.frombuffer(f["places"], "<u4").astype(int):
                        lo, hi = max(0, p - REACH), min(len(raw), p + LENGTH)
                        if f["kind"] == 2:
                            held.setdefault(_deal(raw[p : p + K]) % parts, []).append((doc, key, lo, raw[lo:hi], p - lo))
                            size += hi - lo
                        else:
                            for at in range(lo, hi - LENGTH + 1):
                                w = raw[at : at + LENGTH]
                                old = wins.get(w)
                                if old is None or doc < old[0]:
                                    wins[w] = (doc, key, at)
                                    if old is not None:
                                        local.append(old)
                                elif doc > old[0]:
                                    local.append((doc, key, at))
                                else:
                                    held.setdefault(_deal(w) % parts, []).append((doc, key, at, w, -1))
                                    size += LENGTH
            for w, (doc, key, at) in wins.items():
                held.setdefault(_deal(w) % parts, []).append((doc, key, at, w, -1))
                size += LENGTH
            if local:
                yield _strings(-1, [(d, k, a, b"", -1) for d, k, a in local])
            if size >= SENT:
                for part, strings in held.items():
                    yield _strings(part, strings)
                held, size = {}, 0
        for part, strings in held.items():
            yield _strings(part, strings)

    sent = arrow_map(joined.select("doc_id", "key", "text", "found"), cut, "part long, blob binary")
    # what a batch has decided itself needs no sorting, so it need not meet either
    sent = sent.withColumn("part", F.when(F.col("part") < 0, -1 - F.pmod(F.xxhash64("blob"), F.lit(parts))).otherwise(F.col("part")))

    def sort(table: pa.Table) -> pa.Table:
        packs = [_unpack(b, ("<i8", "<i8", "<u4", "<u4", "u1", "u1")) for b in table.column("blob").to_pylist()]
        doc, key, at, size, share, data = (np.concatenate([p[i] for p in packs]) for i in range(6))
        if not len(data):  # decided already
            return _dealt([(doc, key, np.ones(len(doc), "u1"), at, at + np.uint32(LENGTH))], groups)
        size = size.astype(np.int64)
        begin = np.cumsum(size) - size
        several = len(size) > 2 * most  # strings that may share a window share an anchor, or are windows, so they have one share
        shares = [np.flatnonzero(share == x) for x in np.unique(share)] if several else [np.flatnonzero(share < TOGETHER), np.flatnonzero(share >= TOGETHER)]
        found = []
        for some in (x for x in shares if len(x)):
            of = group_windows if share[some[0]] >= TOGETHER else sort_share
            d, k, p = of(doc[some], key[some], at[some], size[some], data if len(some) == len(size) else data[_within(begin[some], size[some])])
            if not len(d):
                continue
            # neighbouring windows of one document as one span
            order = np.lexsort((p, k, d))
            d, k, p = d[order], k[order], p[order]
            lead = np.ones(len(p), bool)
            lead[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (p[1:] > p[:-1] + 1)
            first = np.flatnonzero(lead)
            last = np.append(first[1:], len(p)) - 1
            found.append((d[first], k[first], np.ones(len(first), "u1"), p[first].astype("<u4"), (p[last] + LENGTH).astype("<u4")))
        return _dealt(found, groups)

    return sent.groupBy("part").applyInArrow(sort, "part long, blob binary").groupBy("part").applyInArrow(_gather, FOUND)


def _within(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the runs that begin there and are so long."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def sort_share(doc: np.ndarray, key: np.ndarray, at: np.ndarray, size: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, key, place) of all windows of these strings that also start in a smaller document among them."""
    end = np.cumsum(size)
    of = np.repeat(np.arange(len(size)), size)
    bucket = refine(data, end[of])
    start = np.flatnonzero(np.arange(len(data)) + LENGTH <= end[of])
    own, number = doc[of[start]], bucket[start]
    least = np.full(len(data) + 2, np.iinfo(np.int64).max)
    np.minimum.at(least, number, own)
    gone = start[own > least[number]]
    o = of[gone]
    return doc[o], key[o], gone - (end - size)[o] + at[o].astype(np.int64)


def group_windows(doc: np.ndarray, key: np.ndarray, at: np.ndarray, size: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``sort_share`` for strings of one window each: equal hashes, then equal bytes."""
    rows, x = data.reshape(-1, LENGTH), np.zeros(len(doc), np.uint64)
    for a in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        x = mix64(x ^ np.ascontiguousarray(rows[:, a : a + 8]).view(np.uint64)[:, 0])
    order = np.lexsort((doc, x))
    head = order[np.maximum.accumulate(np.where(_first_of(order, x), np.arange(len(order)), 0))]
    if (rows[order] != rows[head]).any():  # two strings of one hash
        return sort_share(doc, key, at, size, data)
    gone = order[doc[order] > doc[head]]
    return doc[gone], key[gone], at[gone].astype(np.int64)


def _strings(part: int, strings: list[tuple[int, int, int, bytes, int]]) -> pa.RecordBatch:
    """Strings (doc, key, place, bytes, where the anchor begins in them), with one of ``TOGETHER`` shares by the anchor; -1: a window, with one of as many further shares by itself."""
    d, k, a, s, p = zip(*strings, strict=True)
    share = [zlib.crc32(x[y : y + K]) % TOGETHER if y >= 0 else zlib.crc32(x) % TOGETHER + TOGETHER for x, y in zip(s, p, strict=True)]
    blob = _pack(np.array(d, "<i8"), np.array(k, "<i8"), np.array(a, "<u4"), np.array([len(x) for x in s], "<u4"), np.array(share, "u1"), np.frombuffer(b"".join(s), np.uint8))
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([blob], pa.binary())], ["part", "blob"])


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Union of (start, stop) rows as maximal runs; runs that touch are one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    lead = np.ones(len(spans), bool)
    lead[1:] = spans[1:, 0] > reach[:-1]
    first = np.flatnonzero(lead)
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (binary)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, int(size * 2 / (REACH + 2)) // ENTRIES)
    found = stash(repeats(rows.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)), parts), "repeats")
    edges = open_spans(rows, found.filter("kind in (2, 3)"), parts)
    spans = stash(found.filter("kind in (1, 4)").unionByName(edges), "spans")
    keys = stash(spans.select("doc_id", "key").distinct(), "span_keys")
    per_doc = spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("kind", "places")).alias("found"))
    marked = _suspects(rows, keys)
    none = F.lit(None).cast(per_doc.schema["found"].dataType)
    straight = marked.filter("not hit").select("doc_id", "text", none.alias("found"))
    met = marked.filter("hit").join(per_doc, ["doc_id", "key"], "left").select("doc_id", "text", "found")

    def finish(it):
        for batch in (some for whole in it for some in slices(whole, 1)):
            n, gone, runs, kept = [], [], [], []
            for t, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = t.encode()
                n.append(len(raw))
                if not found:
                    gone.append(0)
                    runs.append(0)
                    kept.append(raw)
                    continue
                spans = []
                for f in found:
                    p = np.frombuffer(f["places"], "<u4").astype(np.int64)
                    spans.append(p.reshape(-1, 2) if f["kind"] == 1 else np.stack([np.maximum(p - REACH, 0), np.minimum(p + LENGTH, len(raw))], axis=1))
                merged, at, out = merge_spans(np.concatenate(spans)), 0, []
                for a, b in merged.tolist():
                    out.append(raw[at:a])
                    at = b
                kept.append(b"".join([*out, raw[at:]]))
                gone.append(int((merged[:, 1] - merged[:, 0]).sum()))
                runs.append(len(merged))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return arrow_map(straight.unionByName(met), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")

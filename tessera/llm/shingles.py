"""Word shingles of whole texts as 64-bit numbers, computed on byte arrays.

A word is hashed eight bytes at a time, each step through the finaliser of
splitmix64, for all words of a block at once; words of more than ``LONG`` bytes
by xxh3.  A step is a bijection, so words of up to eight bytes never collide with
others of their length, and no family of texts collides by the structure of the hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tessera.llm.common import flat_bytes, mix64

BLOCK, LONG = 1 << 20, 512
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The low bytes of a lane that belong to a word with so many bytes left.
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_ODD = np.uint64(0xA0761D6478BD642F)


def _block(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word; ``first``: places at which a text begins."""
    import xxhash

    solid = ~_SPACE[data]
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    starts[first] = solid[first]
    cut = first[first > 0] - 1
    ends[cut] = solid[cut]
    s = np.flatnonzero(starts)
    n = np.flatnonzero(ends) + 1 - s
    low = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", low, 0, (1,))  # the eight bytes from each place on
    h = mix64(n.astype(np.uint64) * _ODD)
    live, at = np.flatnonzero(n <= LONG), 0
    while len(live):
        left = n[live] - at
        h[live] = mix64(h[live] ^ (lanes[s[live] + at] & _MASK[np.minimum(left, 8)])) + _ODD
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(n > LONG):
        h[i] = xxhash.xxh3_64_intdigest(low[s[i] : s[i] + n[i]])
    return s, h


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the text of each.  Works in blocks, so memory beside the words is bounded by the longest word."""
    hashes, places, at = [], [], 0
    inner = offsets[:-1][np.diff(offsets) > 0]
    while at < len(data):
        stop = min(len(data), at + BLOCK)
        while stop < len(data):  # to the next white space or text
            gap = np.flatnonzero(_SPACE[data[stop : stop + BLOCK]])
            follow = inner[np.searchsorted(inner, stop)] if len(inner) and inner[-1] >= stop else len(data)
            stop = min(stop + int(gap[0]) if len(gap) else min(len(data), stop + BLOCK), int(follow))
            if len(gap) or stop == follow:
                break
        lo, hi = np.searchsorted(inner, (at, stop))
        s, h = _block(data[at:stop], inner[lo:hi] - at)
        hashes.append(h)
        places.append(s + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.searchsorted(offsets, np.concatenate(places), side="right") - 1


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Per text its distinct ``width``-word shingles, sorted; a shorter text is one shingle, one without words none."""
    data, offsets = flat_bytes(texts)
    word, of = words(data, offsets)
    n = np.bincount(of, minlength=len(texts)) if len(of) else np.zeros(len(texts), np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    odd = mix64(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    full = np.zeros(max(0, len(word) - width + 1), np.uint64)
    for j in range(width):
        full += word[j : j + len(full)] * odd[j]
    full = mix64(full)
    out = []
    for i, k in enumerate(n):
        if k >= width:
            out.append(np.unique(full[first[i] : first[i + 1] - width + 1]))
        elif k:
            own = word[first[i] : first[i + 1]]
            out.append(mix64((own * odd[:k]).sum(keepdims=True, dtype=np.uint64) + np.uint64(k)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

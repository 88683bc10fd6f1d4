"""Byte-level BPE encoding with a segment tree over adjacent pair ranks, and decoding.

The leaves of a word's tree hold ``rank * width + position`` of each adjacent
pair, inner nodes the minimum of their children; so the root is the leftmost pair
of lowest rank.  A merge changes three leaves, each by a walk to the root, until
the root says that no pair can merge.  Trees of many words are kept as one matrix
and advance together; a word of more than ``WIDE`` bytes has a tree of its own.
Words are encoded once and remembered in a bounded cache of two generations.

Decoding joins the bytes of the ids and reads them as UTF-8, with the replacement
character for what is malformed, as the library does.

Defined cases: null counts as empty (0 tokens, digests of the empty string); the
special string of the file is one token wherever it stands, as is the library's
default; ids may be null or repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, kept, slices

WIDE = 256
#: Leaves of the trees that advance together, so that they stay in a cache.
CELLS = 1 << 16
NONE = np.int64(1) << 60
_SPACE = re.compile(r"\s\s")
#: The published splitting rule of this kind of vocabulary, with white space as Unicode defines it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file: itself if printable, else the next from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Codec:
    def __init__(self, path: str, most: int = 250_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.first = self.rank(*np.meshgrid(self.byte_id, self.byte_id, indexing="ij")).ravel()  # of two bytes
        back = {c: b for b, c in enumerate(letters)}
        self.token = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token |= {i: t.encode() for t, i in self.special.items()}
        self.name = {i: str(i) for i in self.token}
        self.find_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(SPLIT)
        self.most, self.new, self.old = most, {}, {}

    # --- the segment tree ---------------------------------------------------

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where they do not merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(words)
        width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > WIDE:
                out[i] = self.encode_wide(w).tolist()
            else:
                width.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(i)
        for n, some in width.items():
            step = max(1, CELLS // n)
            for k in range(0, len(some), step):
                part = some[k : k + step]
                for i, ids in zip(part, self._forest([words[i] for i in part], n), strict=True):
                    out[i] = ids
        return out

    def _forest(self, words: list[bytes], n: int) -> list[list[int]]:
        """Words of at most ``n`` (a power of two) bytes: one tree a row."""
        rows, size = len(words), np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(w.ljust(n, b"\0") for w in words), np.uint8).reshape(rows, n)
        ids, place = self.byte_id[flat], np.arange(n)
        inside = place < size[:, None]
        after, before = np.tile(place + 1, (rows, 1)), np.tile(place - 1, (rows, 1))
        tree = np.full((rows, 2 * n), NONE * 2)
        r = self.first[flat[:, :-1].astype(np.uint16) << 8 | flat[:, 1:]]
        tree[:, n : 2 * n - 1] = np.where((r < NONE) & inside[:, 1:], r * n + place[:-1], NONE * 2)
        for level in range(n - 1, 0, -1):
            tree[:, level] = np.minimum(tree[:, 2 * level], tree[:, 2 * level + 1])

        def put(row, at, value):
            node = at + n
            tree[row, node] = value
            for _ in range(n.bit_length() - 1):
                node >>= 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            best = tree[row, 1]
            left = best % n
            right = after[row, left]
            ids[row, left] = self.made[best // n]
            inside[row, right] = False
            follow = after[row, right]
            after[row, left] = follow
            ended = follow >= size[row]
            before[row[~ended], follow[~ended]] = left[~ended]
            put(row, right, NONE * 2)
            near = np.where(ended, left, follow)
            r = self.rank(ids[row, left], ids[row, near])
            put(row, left, np.where(ended | (r >= NONE), NONE * 2, r * n + left))
            prev = before[row, left]
            has = prev >= 0
            if has.any():
                own, at = row[has], prev[has]
                r = self.rank(ids[own, at], ids[own, left[has]])
                put(own, at, np.where(r >= NONE, NONE * 2, r * n + at))
            row = row[tree[row, 1] < NONE]
        left, ends = ids[inside].tolist(), np.cumsum(inside.sum(axis=1)).tolist()
        return [left[a:b] for a, b in itertools.pairwise([0, *ends])]

    def encode_wide(self, word: bytes) -> np.ndarray:
        """One word with a tree of its own, in plain Python: n log n for n bytes."""
        n = 1 << (len(word) - 1).bit_length()
        none = 1 << 62
        ids = self.byte_id[np.frombuffer(word, np.uint8)]
        first = self.rank(ids[:-1], ids[1:])
        pairs = {}
        leaves = np.full(n, none, np.int64)
        leaves[: len(ids) - 1] = np.where(first < NONE, first * n + np.arange(len(ids) - 1), none)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(levels[-1].reshape(-1, 2).min(axis=1))
        tree = [none] + [int(x) for level in reversed(levels) for x in level]
        ids, end = ids.tolist(), len(word)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))

        def rank(a, b):
            key = a << 32 | b
            if key not in pairs:
                pairs[key] = int(self.rank(np.array([a]), np.array([b]))[0])
            return pairs[key]

        def put(at, value):
            node = at + n
            tree[node] = value
            while node > 1:
                node >>= 1
                value = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == value:
                    break
                tree[node] = value

        while tree[1] < none:
            r, left = divmod(tree[1], n)
            right = after[left]
            ids[left], ids[right] = int(self.made[r]), -1
            follow = after[left] = after[right]
            put(right, none)
            if follow < end:
                before[follow] = left
                r = rank(ids[left], ids[follow])
                put(left, none if r >= NONE else r * n + left)
            else:
                put(left, none)
            if (prev := before[left]) >= 0:
                r = rank(ids[prev], ids[left])
                put(prev, none if r >= NONE else r * n + prev)
        return np.array([i for i in ids if i >= 0], np.int64)

    # --- texts --------------------------------------------------------------

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def _units(self, text: str) -> list[str]:
        """Pieces whose encodings joined are that of ``text``; boundaries of the splitting rule run between all of them.

        No match runs from a character that is not white space into white
        space, so a lone space or line feed between two others begins a piece;
        texts with white space side by side are split by the rule itself.
        """
        if _SPACE.search(text):
            return self.split.findall(text)
        out: list[str] = []
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append("\n")
            head, *rest = line.split(" ")
            if head:
                out.append(head)
            out += [" " + w for w in rest]
        return out

    def learn(self, units: set[str]) -> None:
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        missing = []
        for u in units - self.new.keys():
            if (got := self.old.get(u)) is not None:
                self.new[u] = got
            else:
                missing.append(u)
        split = self.split.findall
        words = [[u] if (u[1:] if u[0] == " " else u).isalpha() else split(u) for u in missing]  # letters, behind a space or not, are one word by the rule
        distinct = list(dict.fromkeys(itertools.chain.from_iterable(words)))
        ids = dict(zip(distinct, self.encode_words([w.encode() for w in distinct]), strict=True))
        new, name, token = self.new, self.name.__getitem__, self.token.__getitem__
        for u, ws in zip(missing, words, strict=True):
            got = ids[u] if len(ws) == 1 else [i for w in ws for i in ids[w]]
            new[u] = (",".join(map(name, got)), len(got), b"".join(map(token, got)))

    def encode_batch(self, texts: list[str]) -> list[list[tuple[str, int, bytes]]]:
        """Per text the entries (decimal ids joined by commas, number of ids, bytes that they decode to) of its pieces in order."""
        parts = []
        for t in texts:
            if self.find_special and self.find_special.search(t):
                parts.append([u for piece in self.find_special.split(t) for u in ([piece] if piece in self.special else self._units(piece))])
            else:
                parts.append(self._units(t))
        self.learn({u for p in parts for u in p if u not in self.special})
        for s, i in self.special.items():
            self.new[s] = (str(i), 1, self.token[i])
        get = self.new.__getitem__
        return [list(map(get, p)) for p in parts]

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in self.encode_batch([text])[0] for i in ids.split(",") if i]

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


def codec(path: str) -> Codec:
    return kept(Codec, path)


def round_trip(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256.  One narrow pass, no shuffle."""

    def run(it):
        own, ids_of, n_of, bytes_of = codec(tokenizer), itemgetter(0), itemgetter(1), itemgetter(2)
        for batch in it:
            for some in slices(batch, 1):
                n, ids, decoded = [], [], []
                for x in own.encode_batch([t or "" for t in some.column(1).to_pylist()]):
                    n.append(sum(map(n_of, x)))
                    ids.append(hashlib.sha256(",".join(map(ids_of, x)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(map(bytes_of, x)).decode("utf-8", errors="replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and the ids as an array."""

    def run(it):
        own = codec(tokenizer)
        for batch in it:
            for some in slices(batch, 1):
                ids = [[int(i) for part, _, _ in x for i in part.split(",") if i] for x in own.encode_batch([t or "" for t in some.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, ids array<int>")


def decode_column(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Per row of (doc_id, ids): doc_id and the decoded text."""

    def run(it):
        own = codec(tokenizer)
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, text string")

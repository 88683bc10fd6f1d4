"""Erasure coding: stripes of four data and two parity shards over GF(2^8).

The code is systematic: row r of the parity matrix is (1 / (x_r + y_c)) for the
data shards c, a Cauchy matrix, so any four shards give the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATA, PARITY, SHARDS = 4, 2, 6
#: Field polynomial x^8 + x^4 + x^3 + x^2 + 1, block head of one slot byte and 32 of stripe id.
POLYNOMIAL, HEAD = 0x11D, 33
#: What stripe ids are salted with; stripes of another system keep their ids if its salt is passed to ``encode_chunks``.
SALT = b"ec-4+2:"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    exp, log, x = np.zeros(512, np.uint8), np.zeros(256, np.int64), 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x = x << 1 ^ (POLYNOMIAL if x & 0x80 else 0)
    return exp, log


_EXP, _LOG = _tables()


def multiply(a: int, v: np.ndarray) -> np.ndarray:
    return np.where(v == 0, 0, _EXP[_LOG[a] + _LOG[v]]).astype(np.uint8) if a else np.zeros_like(v)


def _inverse(a: int) -> int:
    return int(_EXP[255 - _LOG[a]])


MATRIX = [[int(r == c) for c in range(DATA)] for r in range(DATA)] + [[_inverse((DATA + r) ^ c) for c in range(DATA)] for r in range(PARITY)]


def _solve(rows: list[int]) -> list[list[int]]:
    """Inverse of the matrix of four present shards."""
    m = [MATRIX[r] + [int(i == j) for j in range(DATA)] for i, r in enumerate(rows)]
    for c in range(DATA):
        p = next(i for i in range(c, DATA) if m[i][c])
        m[c], m[p] = m[p], m[c]
        inv = _inverse(m[c][c])
        m[c] = [int(multiply(inv, np.array([x], np.uint8))[0]) for x in m[c]]
        for i in range(DATA):
            if i != c and m[i][c]:
                m[i] = [x ^ int(multiply(m[i][c], np.array([y], np.uint8))[0]) for x, y in zip(m[i], m[c], strict=True)]
    return [row[DATA:] for row in m]


def _combine(weights: list[int], shards: list[np.ndarray]) -> np.ndarray:
    out = np.zeros_like(shards[0])
    for w, s in zip(weights, shards, strict=True):
        out ^= multiply(w, s)
    return out


def encode(data: bytes) -> list[bytes]:
    """Six shards; the last data shard is filled with zeros. An empty chunk is an error."""
    if not data:
        raise ValueError("an empty chunk has no stripe")
    size = -(-len(data) // DATA)
    own = np.frombuffer(data.ljust(size * DATA, b"\0"), np.uint8).reshape(DATA, size)
    return [own[i].tobytes() for i in range(DATA)] + [_combine(MATRIX[DATA + r], list(own)).tobytes() for r in range(PARITY)]


def decode(shards: dict[int, bytes], size: int) -> bytes:
    """The chunk of ``size`` bytes from any four of its shards."""
    if len(shards) < DATA:
        raise ValueError("more than two shards are missing")
    rows = sorted(shards)[:DATA]
    have = [np.frombuffer(shards[r], np.uint8) for r in rows]
    if rows == list(range(DATA)):
        return b"".join(shards[r] for r in rows)[:size]
    return b"".join(_combine(w, have).tobytes() for w in _solve(rows))[:size]


def rebuild(shards: dict[int, bytes], slot: int) -> bytes:
    """Shard ``slot`` from four others."""
    if len(shards) < DATA:
        raise ValueError("more than two shards are missing")
    rows = sorted(shards)[:DATA]
    data = [_combine(w, [np.frombuffer(shards[r], np.uint8) for r in rows]) for w in _solve(rows)]
    return _combine(MATRIX[slot], data).tobytes()


def encode_chunks(chunks: DataFrame, salt: bytes = SALT) -> DataFrame:
    """(id, size, stripe, slot, shard, block_id) of chunks (id, size, data); empty chunks give no row."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            out = []
            for i, size, data in zip(batch["id"], batch["size"], batch["data"], strict=True):
                if data is not None and len(data):
                    stripe = hashlib.sha256(salt + bytes.fromhex(i)).digest()
                    for slot, s in enumerate(encode(bytes(data))):
                        out.append((i, size, stripe.hex(), slot, s, hashlib.sha256(bytes([slot]) + stripe + s).hexdigest()))
            yield pd.DataFrame(out, columns=["id", "size", "stripe", "slot", "shard", "block_id"])

    return chunks.select("id", "size", "data").mapInPandas(run, "id string, size long, stripe string, slot int, shard binary, block_id string")


def _per_stripe(shards: DataFrame, schema: str, fn) -> DataFrame:
    got = shards.groupBy("id", "size").agg(F.collect_list(F.struct("slot", "shard")).alias("shards"))  # six at most

    def run(it):
        for batch in it:
            out = [row for i, size, s in zip(batch["id"], batch["size"], batch["shards"], strict=True) for row in fn(i, size, {x["slot"]: bytes(x["shard"]) for x in s})]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return got.mapInPandas(run, schema)


def decode_chunks(shards: DataFrame) -> DataFrame:
    """(id, data) from whatever shards (id, size, slot, shard) there are; null data if fewer than four."""
    return _per_stripe(shards, "id string, data binary", lambda i, size, s: [(i, decode(s, size) if len(s) >= DATA else None)])


def rebuild_shards(shards: DataFrame) -> DataFrame:
    """(id, slot, shard) of the missing shards of every stripe that has at least four."""
    return _per_stripe(shards, "id string, slot int, shard binary", lambda i, size, s: [(i, slot, rebuild(s, slot)) for slot in range(SHARDS) if slot not in s] if len(s) >= DATA else [])

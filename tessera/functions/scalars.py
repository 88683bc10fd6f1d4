"""Scalar functions as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def human_bytes(n: Column) -> Column:
    """1.5 MiB and the like, halves to even; bytes without decimals."""
    out = F.format_string("%d B", n)
    for power, unit in ((10, "KiB"), (20, "MiB"), (30, "GiB")):
        out = F.when(n >= 1 << power, F.format_string(f"%.1f {unit}", F.bround(n / float(1 << power), 1))).otherwise(out)
    return out


def nice_max(x: Column) -> Column:
    """Smallest 1, 2 or 5 times a power of ten that is not below x; 1 for x not above 0."""
    base = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    return F.when(x <= 0, 1.0).when(x <= base, base).when(x <= 2 * base, 2 * base).when(x <= 5 * base, 5 * base).otherwise(10 * base)


def slot(peer: Column, n: int) -> Column:
    """Slot of a replica id when replacements add multiples of n."""
    return F.pmod(peer - 1, F.lit(n)) + 1


def short_id(h: Column) -> Column:
    return F.substring(h, 1, 12)


def http_status(code: Column) -> Column:
    # Error classes and their HTTP status.
    table = {"not_found": 404, "conflict": 409, "invalid": 400, "quota": 507, "retry": 503, "unauthorized": 401, "corrupt": 500}
    out = F.lit(500)
    for k, v in table.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def rot(data: Column) -> Column:
    """``data`` with the byte in the middle inverted."""
    at = F.floor(F.octet_length(data) / 2).cast("int")
    byte = F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("int")
    flipped = F.unhex(F.lpad(F.hex(F.bitwise_not(byte).bitwiseAND(F.lit(255))), 2, "0"))
    return F.when(F.octet_length(data) == 0, data).otherwise(F.concat(F.substring(data, F.lit(1), at), flipped, F.substring(data, at + 2, F.octet_length(data))))


def repair_bound(dead: int, delay: int, size: Column, rate: int, timeout: int) -> Column:
    """Seconds within which a lost node's bytes must be copied: silence, delay, copying, two timeouts and five seconds."""
    return F.lit(dead + delay + 2 * timeout + 5) + size / rate


def peer_list(text: Column) -> Column:
    """``id=host:port,...`` as an array of structs (id, host, port); entries that are none are left out."""
    entry = r"^([^=,]+)=(.+):(\d+)$"
    parts = F.filter(F.split(text, ","), lambda x: x.rlike(entry))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, entry, 1).alias("id"), F.regexp_extract(x, entry, 2).alias("host"), F.regexp_extract(x, entry, 3).cast("int").alias("port")))


def chance(seed: int, key: Column, p: float) -> Column:
    """True for a share ``p`` of the keys, the same ones for the same seed."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long")
    return draw < int(p * (1 << 32))


def generated(seed: int, key: Column, blocks: Column) -> Column:
    """Seeded file content: ``blocks`` times 64 hexadecimal digits that depend on seed, key and place."""
    block = lambda i: F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(":"), i.cast("string")), 256)
    return F.when(blocks > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(blocks, F.lit(1))), block), "")).otherwise("")


def crc32c(data: Column) -> Column:
    """Castagnoli checksum of binary values; the JVM has only the IEEE one, so whole Arrow batches go through a table, byte place by byte place."""
    @pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1).astype(np.uint32)
        size = values.map(lambda x: -1 if x is None else len(x)).to_numpy(np.int64)
        raw = np.frombuffer(b"".join(x for x in values if x is not None), np.uint8)
        start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
        order = np.argsort(-size, kind="stable")
        crc, longest = np.full(len(size), 0xFFFFFFFF, np.uint32), np.sort(-size)
        for j in range(int(size.max(initial=0))):
            live = order[: np.searchsorted(longest, -j)]  # values of more than j bytes
            crc[live] = table[(crc[live] ^ raw[start[live] + j]) & 255] ^ (crc[live] >> 8)
        out = pd.Series((~crc).astype(np.int64), index=values.index).astype("Int64")
        return out.mask(pd.Series(size < 0, index=values.index))

    return run(data)


def table_line(*columns: Column) -> Column:
    """A tab-separated line of a listing."""
    return F.concat_ws("\t", *[c.cast("string") for c in columns])


def markdown_row(*columns: Column) -> Column:
    """A row of a Markdown table; bars in values are escaped."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]), F.lit(" |"))


def key_record(secret: Column) -> Column:
    """What is stored of an API key: the hash of its secret."""
    return F.sha2(secret, 256)

"""Plumbing shared by the llm operators: scratch tables, Arrow maps, skew-safe joins, Bloom planes."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
_own_scratch: str | None = None


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    A cluster with the package installed does not need it; elsewhere the path
    goes to the workers by their environment.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` if the session names one.

    Only where it is unset, as in tests on one machine, a folder of our own is made.
    """
    global _own_scratch
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        if _own_scratch is None:
            _own_scratch = tempfile.mkdtemp(prefix="tessera-")
        named = f"file://{_own_scratch}"
    return f"{named.rstrip('/')}/tessera/{spark.sparkContext.applicationId}"


def stash(df: DataFrame, name: str, codec: str = "zstd", rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, and a lost executor costs nothing.

    Very large rows go to files of ``rows_per_file``, since Spark decodes whole row groups of up to 4,096 rows.
    """
    spark = session_of(df)
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).option("maxRecordsPerFile", rows_per_file).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more, and let Spark drop the shuffle files of jobs that are done."""
    for t in tables:
        spark = session_of(t)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.stashed_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean_up(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; call it when no result is read any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of rows in a batch that goes to Python; Spark's own limit is 10,000 rows, which for texts is a whole split of the input.
BATCH = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Send rows to Python in batches of about ``BATCH`` bytes, unless the session has a limit of its own.

    A batch is held by the executor's JVM outside its heap and by the worker, on the way there and
    back.  The setting is the session's and stays, as plans read it when they run.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    ship(session_of(df))

    def run(it):
        global _asked
        _asked = False
        try:
            yield from fn(it)
        finally:
            drop_kept()
            release()

    return df.mapInArrow(run, schema)


def packed(docs: DataFrame, text: str) -> tuple[DataFrame, int]:
    """``docs`` with all its columns as one struct ``row``, and the place of ``text`` in it.

    A Python worker takes the text out of the struct (``batch.column(0).field(place)``), so it goes there once, not beside its row again.
    """
    place = [c.lower() for c in docs.columns].index(text.lower())
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), place


_kept: tuple = (None, None)
_asked = False


def kept(make: Callable, *args):
    """``make(*args)``, remembered from task to task by a Python worker.

    One thing at a time: a worker serves many stages, and what the last operator
    kept (a tokenizer with its caches) goes when a task asks for another or ends without asking.
    """
    global _kept, _asked
    _asked = True
    if _kept[0] != (make, args):
        _kept = (None, None)
        release()
        _kept = ((make, args), make(*args))
    return _kept[1]


def drop_kept() -> None:
    global _kept
    if not _asked:
        _kept = (None, None)


def release() -> None:
    """Give freed memory back: a Python worker lives on and serves other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose ``column`` holds about ``most`` bytes; one longer value is a run of its own."""
    yield from _runs(batch, batch.column(column), most)


def row_slices(batch: pa.RecordBatch, place: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """``slices`` by field ``place`` of the struct in the first column."""
    yield from _runs(batch, batch.column(0).field(place), most)


def _runs(batch: pa.RecordBatch, values: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def flat_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a string or binary array as one byte array and int64 offsets; null counts as empty."""
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type):
        kind = np.int64
    else:
        kind = np.int32
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def attach_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Left join of ``rows`` with one row per key in ``groups``, safe for keys that hold a large share of the rows.

    ``groups[size]`` says how many of the ``total`` rows have the key.  Keys
    with at least ``total / 1024`` rows are at most 1,024 by counting, so they
    are broadcast; all other keys are joined by shuffle, where no task can
    get more than that many rows of one key.
    """
    least = max(1000, total // 1024)
    hot, rest = groups.filter(F.col(size) >= least), groups.filter(F.col(size) < least)
    tagged = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    extra = [c for c in groups.columns if c not in keys]
    cold = tagged.filter("_hot is null").drop("_hot", *extra).join(rest, keys, "left")
    return tagged.filter("_hot").drop("_hot").select(*rows.columns, *extra).unionByName(cold.select(*rows.columns, *extra))


# --- Bloom planes -----------------------------------------------------------

HASHES = 6


def cells(h1: np.ndarray, h2: np.ndarray, size: int) -> np.ndarray:
    """(n, HASHES) cell numbers by double hashing."""
    i = np.arange(HASHES, dtype=np.uint64)
    return ((h1[:, None] + i * (h2 | np.uint64(1))[:, None]) % np.uint64(size)).astype(np.int64)


class Planes:
    """A Bloom filter of two bit planes: cells hit by at least one key, and by at least two.

    ``merge`` is associative and commutative, so partial planes of many tasks
    can be merged in any tree.
    """

    def __init__(self, size: int, once: np.ndarray | None = None, twice: np.ndarray | None = None):
        self.size = size
        self.once = np.zeros(-(-size // 8), np.uint8) if once is None else once
        self.twice = np.zeros(-(-size // 8), np.uint8) if twice is None else twice

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        got = np.sort(cells(h1, h2, self.size), axis=1)
        fresh = np.ones(got.shape, bool)
        fresh[:, 1:] = got[:, 1:] != got[:, :-1]  # a key's own cells count once
        cell, n = np.unique(got[fresh], return_counts=True)
        seen = (self.once[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1
        again = cell[(n > 1) | (seen == 1)]
        np.bitwise_or.at(self.twice, again >> 3, np.left_shift(1, again & 7).astype(np.uint8))
        np.bitwise_or.at(self.once, cell >> 3, np.left_shift(1, cell & 7).astype(np.uint8))

    def merge(self, once: np.ndarray, twice: np.ndarray) -> None:
        self.twice |= twice | (self.once & once)
        self.once |= once

    @staticmethod
    def hit(plane: np.ndarray, size: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        cell = cells(h1, h2, size)
        return ((plane[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1).all(axis=1)


def build_planes(keys: DataFrame, hashes: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], size: int, fan: int = 16) -> Planes:
    """Planes over all rows: one partial pair a task, merged in ``fan`` tasks, then on the driver (``fan`` pairs of ``size / 4`` bytes)."""

    def build(it):
        own, some = Planes(size), False
        for batch in it:
            if batch.num_rows:
                own.add(*hashes(batch))
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([own.once.tobytes()], pa.binary()), pa.array([own.twice.tobytes()], pa.binary())], ["once", "twice"])

    def merge(it):
        own, some = Planes(size), False
        for batch in it:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                own.merge(np.frombuffer(a.as_buffer(), np.uint8), np.frombuffer(b.as_buffer(), np.uint8))
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([own.once.tobytes()], pa.binary()), pa.array([own.twice.tobytes()], pa.binary())], ["once", "twice"])

    schema = "once binary, twice binary"
    parts = arrow_map(keys, build, schema)
    whole = Planes(size)
    for row in arrow_map(parts.repartition(fan), merge, schema).toLocalIterator():
        whole.merge(np.frombuffer(row.once, np.uint8), np.frombuffer(row.twice, np.uint8))
    return whole

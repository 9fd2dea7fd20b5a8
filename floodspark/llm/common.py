"""What the corpus operators share: tables in the shared folder, text bytes of Arrow columns, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from floodspark.session import shared_dir

BLOCK_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; every executor can read and write it."""
    _MADE.append(f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex[:12]}")
    return f"{_MADE[-1]}/{name}"


def release(spark: SparkSession) -> int:
    """Delete the folders that this process has made so far; results that read them must be written before."""
    conf, paths = spark._jsc.hadoopConfiguration(), [spark._jvm.org.apache.hadoop.fs.Path(p) for p in _MADE]
    _MADE.clear()
    return sum(bool(p.getFileSystem(conf).delete(p, True)) for p in paths)


def stored(df: DataFrame, name: str, *partition: str, rows: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, lost executors cost no replay.

    With ``rows``, a file holds at most so many, so that large rows are read by many tasks.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).partitionBy(*partition).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``df``, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it is written, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


_KEPT: dict = {}


def kept(kind, source, make):
    """The one object that this Python worker keeps between tasks; another kind or source takes its place."""
    have = _KEPT.get(kind)
    if have is None or have[0] is not source:
        _KEPT.clear()
        have = _KEPT[kind] = (source, make())
    return have[1]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column without copying; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    _, bounds, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(bounds, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def text_blocks(data: np.ndarray, at: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: first row, last row (exclusive), bytes, bounds from 0."""
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j, data[at[i]:at[j]], at[i:j + 1] - at[i]
        i = j


def byte_table(inside: bytes | None = None, outside: bytes | None = None) -> np.ndarray:
    """A truth value for each byte value: those of ``inside``, or all but those of ``outside``."""
    found = np.zeros(256, bool)
    found[list(inside if inside is not None else outside)] = True
    return found if inside is not None else ~found


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of the splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = np.uint64(0x9FB21C651E98DF25)


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts of one block after A-Z became a-z: 64-bit hash, start, end, and how many each text has.

    Equal words have equal hashes; different ones meet with a chance of about 2**-64 per pair.
    """
    low = LOWER[data]
    w = is_word[low]
    if not w.any():
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(at) - 1, np.int64)
    first = w.copy()
    first[1:] &= ~w[:-1]
    opens = at[:-1][at[:-1] < at[1:]]
    first[opens] = w[opens]
    last = w.copy()
    last[:-1] &= ~w[1:]
    closes = at[1:][at[:-1] < at[1:]] - 1
    last[closes] = w[closes]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    where = np.flatnonzero(w)
    length = end - start
    place = where - np.repeat(start, length)
    terms = BYTE_CODES[low[where]] * powers(int(length.max()))[place]
    hashes = mix(np.add.reduceat(terms, np.cumsum(length) - length) + length.astype(np.uint64))
    counts = np.diff(np.searchsorted(start, at))
    return hashes, start, end, counts


def runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of true marks."""
    step = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)

"""Helpers shared by the training-data operators: scratch tables, word hashes, 64-bit mixing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import time
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries of a per-process cache before it is emptied; bounds a Python worker's memory.
CACHE_ENTRIES = 150_000
#: Rows of a table that is broadcast, of some 30 bytes each; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_RUN = uuid.uuid4().hex[:12]
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def shared_folder(spark: SparkSession) -> str:
    """A folder of this run under spark.checkpoint.dir, which all executors share.

    Where that is unset, a local master gets a temporary folder; on a cluster it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veilframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/veilframe-{_RUN}"


def _forget(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may be gone when the interpreter ends
        pass


_registered: set[str] = set()
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage durably."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder not in _registered:
        _registered.add(folder)
        atexit.register(_forget, spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex[:10]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def light(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A stored table of few narrow columns, broadcast to joins if it has BROADCAST_ROWS rows at most.

    rows: what to count where the table's own rows hold lists.
    """
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in frames:
        _forget(df.sparkSession, _paths.pop(df))


def release(spark: SparkSession) -> None:
    """Let the driver notice finished plans that nothing refers to, so their shuffle files are deleted now.

    The first collection frees what Python's references held, the second what those plans held.
    """
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.2)
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int):
    """Context manager: Arrow batches of at most so many rows for the actions run inside."""
    return _Conf(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


class _Conf:
    def __init__(self, spark: SparkSession, key: str, value: str):
        self.spark, self.key, self.value = spark, key, value

    def __enter__(self):
        self.before = self.spark.conf.get(self.key, None)
        self.spark.conf.set(self.key, self.value)

    def __exit__(self, *_):
        if self.before is None:
            self.spark.conf.unset(self.key)
        else:
            self.spark.conf.set(self.key, self.before)


def give_back() -> None:
    """Return the memory that this Python worker has freed to the system; a worker outlives its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def tidy(run):
    """An Arrow task, run, that gives freed memory back when it ends."""

    def task(batches):
        yield from run(batches)
        give_back()

    return task


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered within bounds."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = WordHashes()


def words_of(data: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of UTF-8 text with A-Z lower-cased; null has none."""
    return data.lower().split() if data else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive word hashes, in order; empty when there are fewer."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = mix64(hashes[: len(hashes) - n + 1] + _GOLDEN)
    for i in range(1, n):
        out = mix64(out * _GOLDEN + hashes[i : len(hashes) - n + 1 + i])
    return out


def rows_of(batches: Iterator) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()

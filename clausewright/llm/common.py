"""What the corpus operators share: tables, the shared folder, words and hashes."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries of the word caches below; a full cache is emptied, which changes speed only.
CACHE_ENTRIES = 120_000
#: Characters of a word that is remembered at most, which bounds the caches in bytes.
LONG_WORD = 64

#: Rows that are handed to Python at once: whole texts, so that few megabytes are held.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the rows of an Arrow batch to BATCH_ROWS; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    small_batches(spark)
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="clausewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, label: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and reread: cuts the lineage and outlives executors.

    The files stay until the owner of the shared folder clears it."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/clausewright-{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def values(column):
    """The Python values of an Arrow column, some hundreds at a time, so that few texts are held at once."""
    for a in range(0, len(column), 256):
        yield from column.slice(a, 256).to_pylist()


def free() -> None:
    """Gives what Arrow and the C library hold in reserve back to the system: Python workers are used again and again."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def freed(f):
    """f, a function over a task's batches, that frees its memory when the task ends."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            free()

    return run


class WordHashes(dict):
    """64-bit hashes of words, remembered unless they are longer than LONG_WORD."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= LONG_WORD:
            self[word] = h
        return h


MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of n words (lower-cased, split at white space).

    A text of fewer than n words has one shingle, all its words; one without words has none."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        out = mixed(out * MIX + h[i : len(h) - width + 1 + i])
    return np.unique(out)


#: Rows with spans or terms of a text that a join broadcasts at most (some tens of megabytes).
BROADCAST_ROWS = 50_000


def null_safe(key: str, other: str) -> Column:
    return F.col(key).eqNullSafe(F.col(other))


#: Ids that a semi-join broadcasts at most (8 MB); more are joined by shuffling both sides.
BROADCAST_IDS = 1_000_000


def among(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The rows of df whose key is in ids, or with left_anti is not in them (one column of that name, materialised): broadcast if few, else shuffled."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, how)


#: Rows of a key that make it hot: beyond, its side of a join is broadcast, so that its rows stay where they are.
HOT_ROWS = 10_000


def spread_join(rows: DataFrame, one: DataFrame, key: str, how: str = "left", counts: DataFrame | None = None) -> DataFrame:
    """rows joined with `one`, which has one row for each key and is materialised; counts: the keys with _n rows, if known.

    Broadcast if `one` has few rows. Else the rows of hot keys, of which there are at most rows / HOT_ROWS, meet a
    broadcast of their part of `one`, and only the others are shuffled."""
    if one.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(one), key, how)
    counts = rows.groupBy(key).agg(F.count("*").alias("_n")) if counts is None else counts
    hot = materialise(counts.where((F.col("_n") > HOT_ROWS) & F.col(key).isNotNull()).select(key), "hot")
    if hot.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return rows.join(one, key, how)
    hot = F.broadcast(hot)
    few = one.join(hot, key, "left_semi")
    return rows.join(hot, key, "left_semi").join(F.broadcast(few), key, how).unionByName(rows.join(hot, key, "left_anti").join(one, key, how))

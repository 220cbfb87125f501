"""Helpers shared by the text operators: tables, lineage cuts, skew-safe group lookups, vectorised word scanning."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.shipping import ship

#: Parts into which each key is split before it is aggregated or joined, so that a hot key is many keys.
SALTS = 256
#: UTF-8 bytes of text that the vectorised scanners hold at once (a longer text is held alone).
SLICE_BYTES = 2 << 20
#: Rows of text in an Arrow batch.
ARROW_ROWS = 500
ARROW_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in tests without one, a folder below the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    return at or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read again: later steps do not recompute it and lost executors do not lose it."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete what cut() wrote for these, once nothing reads it any more."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_in_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """df.mapInArrow, on executors that may not have this package.

    Rows hold whole texts, so the session's default of 10,000 rows in an Arrow batch is lowered to ARROW_ROWS, unless the
    user has set it.
    """
    spark = df.sparkSession
    ship(spark)
    if ARROW_SETTING not in spark.conf.getAll:
        spark.conf.set(ARROW_SETTING, str(ARROW_ROWS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return df.mapInArrow(work, schema)


def salt(by: Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")


def digests(data: list[bytes]) -> np.ndarray:
    """XXH3 of 128 bits of each, as two signed 64-bit columns."""
    held = b"".join([xxhash.xxh3_128_digest(x) for x in data])
    return np.frombuffer(held, ">i8").astype(np.int64).reshape(-1, 2)


def with_group(df: DataFrame, key: str, spread: str, aggs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """df with aggregates of its key's group on each row; no task holds all rows of a hot key.

    aggs: name -> (aggregate of rows, aggregate of those partial values, which it reads under the same name).
    spread: a column by which the rows of a key are dealt over SALTS parts. Null keys form no group.
    """
    salted = df.withColumn("_salt", salt(F.col(spread)))
    parts = salted.groupBy(key, "_salt").agg(*(a.alias(n) for n, (a, _) in aggs.items()))
    whole = parts.groupBy(key).agg(*(b.alias(n) for n, (_, b) in aggs.items()))
    # At most SALTS rows of a key meet here, and its share of the rows below.
    looked = parts.select(key, "_salt").join(whole, key)
    return salted.join(looked, [key, "_salt"]).drop("_salt")


def lookup(df: DataFrame, key: str | list[str], spread: str, rows: DataFrame, how: str = "inner") -> DataFrame:
    """df joined with rows, which hold each key once; a hot key's rows of df are dealt over SALTS parts. how: inner or left."""
    keys = [key] if isinstance(key, str) else key
    salted = df.withColumn("_salt", salt(F.col(spread)))
    looked = salted.select(*keys, "_salt").distinct().join(rows, keys)
    return salted.join(looked, [*keys, "_salt"], how).drop("_salt")


# Vectorised scanning of words -------------------------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words that are runs of anything but ASCII white space.
NOT_SPACE = ~SPACE
#: Bytes of words that are runs of 0-9, a-z and everything beyond ASCII (in UTF-8 those bytes are all over 0x7F).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SAME = np.arange(256, dtype=np.uint8)

def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and where each row's begin (one more at the end); null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text and ARROW_ROWS rows at most."""
    for batch in batches:
        _, at = texts_of(batch[text])
        lo = 0
        while lo < len(batch):
            hi = min(lo + ARROW_ROWS, max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1))
            yield batch.slice(lo, hi - lo)
            lo = hi


class Words:
    """The words of a slice of texts: start, end (byte places), row, first (a row's first word; one more at the end)."""

    def __init__(self, data: np.ndarray, at: np.ndarray, within: np.ndarray = NOT_SPACE, fold: np.ndarray = SAME):
        self.data, self.at, self.fold = data, at, fold
        self.inside = inside = within[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(at) - 1), self.count)

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all words with a space after each, and where each word's begin."""
        size = self.end - self.start
        start = np.cumsum(size + 1) - (size + 1)
        out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        held = self.fold[self.data[self.inside]]
        out[np.arange(len(held)) + np.repeat(np.arange(len(size)), size)] = held
        return out, start

    def hashes(self) -> np.ndarray:
        """A 64-bit hash (XXH3) of each word; each distinct word of the slice is hashed once."""
        edges = np.append(0, np.cumsum(self.end - self.start))
        held = self.fold[self.data[self.inside]]
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(held)])
        kinds = column.dictionary_encode()
        of = np.array([xxhash.xxh3_64_intdigest(w) for w in kinds.dictionary.to_pylist()], np.uint64)
        return of[kinds.indices.to_numpy()]


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n neighbouring word hashes (empty if there are fewer)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out) + h[k : k + len(out)]
    return mix(out)

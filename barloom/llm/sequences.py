"""Ordered rows of keys of any size: their places, dense names of distinct values, digests of joined pieces.

A key's rows may fill many tasks: rows are dealt by ranges of (key, order), so a hot key lies in neighbouring partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from barloom.llm.common import cut, map_in_arrow

#: Characters of role and text that decide the order of a conversation's rows of one turn, before their digests do.
LEAD = 64
#: Pieces, and about as many characters, of a chunk of text that is digested later.
CHUNK_PIECES, CHUNK_CHARS = 4096, 1 << 20


def by_range(df: DataFrame, *by: str) -> DataFrame:
    """df in one order over all partitions (nulls first). by: columns of bounded size; rows that tie may lie in several partitions."""
    spread = df.withColumn("_spread", F.monotonically_increasing_id())
    return spread.repartitionByRange(*by, "_spread").drop("_spread").sortWithinPartitions(*by)


def turn_digest(role: str = "role", text: str = "text") -> Column:
    """By which turns are told apart: MD5 of role and text."""
    return F.unhex(F.md5(F.concat_ws(":", F.length(role), role, text).cast("binary")))


def in_turn_order(said: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text; role and text without nulls) with turn_md5, by conv_id and turn (nulls first).

    Rows of one turn are in order of the first LEAD characters of role and text, then of their digest; equal rows are
    interchangeable, so copies of a row may fill many partitions.
    """
    said = said.withColumns({"turn_md5": turn_digest(), "_role": F.substring("role", 1, LEAD), "_text": F.substring("text", 1, LEAD)})
    return by_range(said, "conv_id", "turn", "_role", "_text", "turn_md5").drop("_role", "_text")


def runs(column: pa.Array) -> np.ndarray:
    """Where runs of equal values (null equals null) begin in a column."""
    if len(column) < 2:
        return np.zeros(min(len(column), 1), np.int64)
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return np.append(0, np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1)


def numbered(ordered: DataFrame, key: str, what: str) -> DataFrame:
    """Rows as by_range() gives them, written to the shared folder, with pos: a row's place (from 0) among its key's rows."""
    schema = StructType([*ordered.schema.fields]).add("_part", IntegerType()).add("_at", LongType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, done = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            begin = runs(batch[key])
            at = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
            head = begin[1] if len(begin) > 1 else n
            if last is not None and batch[key][0].as_py() == last[0]:
                at[:head] += done
            last, done = (batch[key][n - 1].as_py(),), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(at)], schema.names)

    rows = cut(map_in_arrow(ordered, work, schema), what)
    counts = rows.groupBy(key, "_part").agg((F.max("_at") + 1).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # A border between two partitions cuts one key at most, so these are fewer rows than there are partitions.
    more = counts.withColumn("_before", before).where("_before IS NOT NULL").select(F.col(key).alias("_key"), F.col("_part").alias("_in"), "_before")
    joined = rows.join(F.broadcast(more), (F.col("_part") == F.col("_in")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.select(*ordered.columns, (F.col("_at") + F.coalesce("_before", F.lit(0))).alias("pos"))


def dense(values: DataFrame, first: int, what: str) -> tuple[DataFrame, int]:
    """Distinct rows with a name each: first, first + 1, ... without gaps. Also how many there are."""
    at = F.col("_at")
    rows = cut(values.withColumn("_at", F.monotonically_increasing_id()), what)
    counts = sorted((r[0], r[1]) for r in rows.groupBy(F.shiftright(at, 33)).count().collect())  # a row for each partition
    if not counts:
        return rows.withColumnRenamed("_at", "name"), 0
    ends = np.cumsum([n for _, n in counts])
    starts = values.sparkSession.createDataFrame([(p, first + int(e) - n) for (p, n), e in zip(counts, ends)], "_p BIGINT, _first BIGINT")
    name = (F.col("_first") + at.bitwiseAND(F.lit((1 << 33) - 1))).alias("name")
    return rows.join(F.broadcast(starts), F.shiftright(at, 33) == F.col("_p")).select(*values.columns, name), int(ends[-1])


def joined_sha256(pieces: DataFrame, keys: list[str], order: list[str], piece: str, separator: str) -> DataFrame:
    """keys, sha256: SHA-256 (lower-case hex) of each key's pieces, in order, joined by a separator. Keys aren't null.

    Tasks join thousands of neighbouring pieces each before sha256_of_chunks() takes them.
    """
    ordered = by_range(pieces.select(*keys, *order, piece), *keys, *order).select(*keys, piece)
    chunk = StructType([ordered.schema[k] for k in keys]).add("_part", IntegerType()).add("_no", LongType()).add("_text", StringType())

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, held, size, last = TaskContext.get().partitionId(), 0, [], 0, None
        for batch in batches:
            ready: list[tuple] = []
            for own, text in zip(zip(*(batch[k].to_pylist() for k in keys)), batch[piece].to_pylist()):
                if held and (own != last or len(held) >= CHUNK_PIECES or size >= CHUNK_CHARS):
                    ready.append((*last, part, no, separator.join(held)))
                    held, size, no = [], 0, no + 1
                last = own
                held.append(text)
                size += len(text)
            yield from as_batch(ready, chunk)
        if held:
            yield from as_batch([(*last, part, no, separator.join(held))], chunk)

    return sha256_of_chunks(map_in_arrow(ordered, collect, chunk), keys, ["_part", "_no"], "_text", separator)


def sha256_of_chunks(chunks: DataFrame, keys: list[str], order: list[str], text: str, separator: str) -> DataFrame:
    """keys, sha256 of each key's chunks, in order, joined by a separator.

    A digest takes its bytes one after another, so a key's chunks end in one task, which goes through them as a stream.
    """
    out = StructType([chunks.schema[k] for k in keys]).add("sha256", StringType())

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            ready: list[tuple] = []
            for own, more in zip(zip(*(batch[k].to_pylist() for k in keys)), batch[text].to_pylist()):
                if own != last:
                    if last is not None:
                        ready.append((*last, state.hexdigest()))
                    last, state = own, hashlib.sha256()
                else:
                    state.update(separator.encode())
                state.update(more.encode())
            yield from as_batch(ready, out)
        if last is not None:
            yield from as_batch([(*last, state.hexdigest())], out)

    return map_in_arrow(chunks.select(*keys, *order, text).repartition(*keys).sortWithinPartitions(*keys, *order), digest, out)


def as_batch(rows: list[tuple], schema: StructType) -> Iterator[pa.RecordBatch]:
    """Rows as a batch of this schema; none make none."""
    if rows:
        kinds = to_arrow_schema(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)


def total(values: Column) -> Column:
    return F.coalesce(F.sum(values), F.lit(0)).cast("long")

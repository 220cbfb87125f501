"""Language-model scoring by context-tree weighting over bytes, beside a unigram base over words.

A text is its lower-cased (A-Z) words, one space between two, and an end. Each byte is eight binary decisions; each
decision has a tree over contexts of 0 to DEPTH preceding bytes, whose nodes hold Krichevsky-Trofimov estimates, and
the weighted mixture of all depths gives its probability. Counts of byte runs are summed over the corpus in Spark.
Trees are worked out in pieces: tasks with all runs of the same NEAR latest context bytes hold the deepest two levels,
tasks with all nodes of the same two bytes the next two, and the driver the first two (65,280 nodes at most). A node's
weight is a sum over the nodes below, so each piece passes sums up, and what a decision has gathered from the root is
passed down, by joins in which a node meets 256 others at most: no byte pair, however frequent, is one task. Code
lengths of the most frequent runs, in a table of a bounded size, are looked up where the texts lie; only what is not in
that table is joined with the rest of them by shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import LOWER, NOT_SPACE, Words, cut, discard, lookup, map_in_arrow, slices, texts_of

#: Context bytes. A run of DEPTH + 1 bytes is packed in 64 bits.
DEPTH = 5
#: Latest context bytes by which runs are dealt to tasks: at most 65,536 runs share them.
NEAR = 4
#: Most entries of a lookup table that is broadcast (16 bytes each).
HEAD_ROWS = 1 << 20
#: Byte runs whose trees one task should work out.
TREE_ROWS = 1 << 17
#: Distinct values that a task gathers before it passes their counts on.
HELD_ROWS = 1 << 19
#: UTF-8 bytes of text whose runs a task holds at once.
PART_BYTES = 1 << 20


def runs(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All runs of DEPTH + 1 bytes of the texts' streams, packed, and how many each text has.

    A stream begins after DEPTH ends, so a text has as many runs as bytes, its end included.
    """
    data, at = texts_of(batch)
    held, at, pad = data.tobytes(), at.tolist(), b"\n" * DEPTH
    parts = [pad + b" ".join(held[a:b].lower().split()) + b"\n" for a, b in zip(at[:-1], at[1:], strict=True)]
    size = np.array([len(p) for p in parts])
    stream = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    n = len(stream) - DEPTH
    packed = stream[:n].copy()
    for k in range(1, DEPTH + 1):
        packed <<= np.uint64(8)
        packed |= stream[k : k + n]
    within = np.ones(len(stream), bool)
    within[(np.cumsum(size)[:, None] - 1 - np.arange(DEPTH)).ravel()] = False
    return packed[within[:n]], size - DEPTH


class Sums:
    """Sums of counts by 64-bit key, gathered in a task."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > 2 * HELD_ROWS:
            self.merge()

    def merge(self) -> None:
        if len(self.keys) > 1:
            keys, inverse = np.unique(np.concatenate(self.keys), return_inverse=True)
            self.counts = [np.bincount(inverse, np.concatenate(self.counts)).astype(np.int64)]
            self.keys = [keys]
        self.held = sum(map(len, self.keys))

    def full(self) -> bool:
        return self.held > HELD_ROWS

    def drain(self, kind: int) -> Iterator[pa.RecordBatch]:
        self.merge()
        for keys, counts in zip(self.keys, self.counts, strict=True):
            for lo in range(0, len(keys), 1 << 18):
                part = keys[lo : lo + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part.view(np.int64)), pa.array(counts[lo : lo + (1 << 18)].astype(np.int64))], COUNTS.names)
        self.__init__()


RUN, WORD, END = 0, 1, 2
COUNTS = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])


def count(docs: DataFrame) -> DataFrame:
    """kind, key, n: training counts of byte runs, words (by hash) and ends; docs: text and training (boolean).

    Runs that only texts outside training have are there too, with n = 0.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, ends = {RUN: Sums(), WORD: Sums()}, 0
        for batch in slices(batches, "text", PART_BYTES):
            mine = batch["training"].to_numpy(zero_copy_only=False).astype(bool)
            for training in (True, False):
                texts = batch["text"].filter(pa.array(mine == training))
                if not len(texts):
                    continue
                packed, _ = runs(texts)
                keys, n = np.unique(packed, return_counts=True)
                sums[RUN].add(keys, n if training else np.zeros_like(n))
                if training:
                    ends += len(texts)
                    sums[WORD].add(Words(*texts_of(texts), NOT_SPACE, LOWER).hashes())
            for kind, s in sums.items():
                if s.full():
                    s.merge()
                    if s.full():
                        yield from s.drain(kind)
        for kind, s in sums.items():
            yield from s.drain(kind)
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.int32()), pa.array([0], pa.int64()), pa.array([ends], pa.int64())], COUNTS.names)

    return map_in_arrow(docs, work, COUNTS).groupBy("kind", "key").agg(F.sum("n").alias("n"))


# Context trees --------------------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0, by Stirling's series at x + 8."""
    down = np.log(x)
    for k in range(1, 8):
        down = down + np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - down


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1)


class Level:
    """Nodes (context of some depth, bits of the byte so far) of the trees: counts and what each weighs its own estimate."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        own = log_kt(zeros, ones)
        self.log_weighted = own if below is None else np.logaddexp(own, below) - np.log(2)
        self.own = np.ones(len(keys)) if below is None else np.exp(own - np.log(2) - self.log_weighted)
        self.estimate = (ones + 0.5) / (zeros + ones + 1)

    def at(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, keys)


def _nodes(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run its eight decisions: the bits of its last byte before each (after a leading 1), and the bit."""
    byte = (packed & np.uint64(0xFF)).astype(np.int64)
    k = np.arange(8)
    return (byte[:, None] | 256) >> (8 - k), (byte[:, None] >> (7 - k)) & 1


def _keys(packed: np.ndarray, prefix: np.ndarray, depth: int) -> np.ndarray:
    context = (packed >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)
    return (context[:, None] << np.uint64(8)) | prefix.astype(np.uint64)


def levels(packed: np.ndarray, counts: np.ndarray, to: int) -> list[Level]:
    """Levels of depth `to` to DEPTH of the trees of these runs."""
    prefix, bit = _nodes(packed)
    out: list[Level] = []
    weight = np.repeat(counts.astype(float), 8)
    for depth in range(DEPTH, to - 1, -1):
        keys, inverse = np.unique(_keys(packed, prefix, depth).ravel(), return_inverse=True)
        inverse = inverse.ravel()
        ones = np.bincount(inverse, weight * bit.ravel(), len(keys))
        zeros = np.bincount(inverse, weight, len(keys)) - ones
        below = None
        if out:
            up = out[-1]
            context = (up.keys >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)
            below = np.bincount(np.searchsorted(keys, (context << np.uint64(8)) | (up.keys & np.uint64(0xFF))), up.log_weighted, len(keys))
        out.append(Level(keys, zeros, ones, below))
    return out[::-1]


def descend(keys: np.ndarray, level: Level, p: np.ndarray, total: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What decisions have gathered once a level's nodes `keys` are passed: probability of a one, own shares so far, what is left.

    Each node gives its own estimate its weight and leaves the rest to the next depth; the deepest node that training
    reached takes all that is left, so the probabilities of all bytes sum to one.
    """
    at = level.at(keys)
    seen = (level.zeros + level.ones)[at] > 0
    estimate, own = level.estimate[at], level.own[at]
    return np.where(seen, total + left * estimate, p), total + np.where(seen, left * own * estimate, 0), left * np.where(seen, 1 - own, 1)


def log10_run(packed: np.ndarray, trees: list[Level], depth: int = 0, above: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
    """log10 of the mixture's probability of each run's last byte after its context.

    trees: levels from `depth` on; above: for each run and decision what the levels above have gathered.
    """
    prefix, bit = _nodes(packed)
    state = above or (np.full(bit.shape, 0.5), np.zeros(bit.shape), np.ones(bit.shape))
    for k, level in enumerate(trees, depth):
        state = descend(_keys(packed, prefix, k), level, *state)
    return np.log10(np.where(bit == 1, state[0], 1 - state[0])).sum(axis=1)


LONG, DOUBLE = T.LongType(), T.DoubleType()
NODE = T.StructType([T.StructField("key", LONG), *(T.StructField(c, DOUBLE) for c in ("zeros", "ones", "below"))])
STATE = T.StructType([T.StructField("key", LONG), *(T.StructField(c, DOUBLE) for c in ("p", "total", "left"))])
COST = T.StructType([T.StructField("key", LONG), T.StructField("n", LONG), T.StructField("value", DOUBLE)])


def _sum_to(keys: np.ndarray, depth: int, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys of the nodes of that depth above nodes of the next, in order, and sums of the columns."""
    context = (keys >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)
    up, inverse = np.unique((context << np.uint64(8)) | (keys & np.uint64(0xFF)), return_inverse=True)
    return up, *(np.bincount(inverse, x, len(up)) for x in columns)


def _batch(keys: np.ndarray, columns: tuple[np.ndarray, ...], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, columns)], names)


def _columns(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray] | None:
    some = [b for b in batches if len(b)]
    t = pa.Table.from_batches(some) if some else None
    return t and {c: t[c].to_numpy() for c in t.schema.names}


def code_lengths(run_counts: DataFrame, parts: int) -> DataFrame:
    """key, n, value: each byte run's log10 probability of its last byte; run_counts: key, n."""
    context = lambda c, n: F.shiftright(c, 8).bitwiseAND(F.lit((1 << 8 * n) - 1))
    parent = F.shiftleft(context("key", NEAR - 1), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(0xFF)))
    dealt = run_counts.select(context("key", NEAR).alias("near"), "key", "n").repartition(parts, "near")

    def deep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (t := _columns(batches)) is None:
            return
        level = levels(t["key"].view(np.uint64), t["n"], NEAR)[0]
        yield _batch(level.keys, (level.zeros, level.ones, level.log_weighted), NODE.names)

    def pair(batches: Iterator[pa.RecordBatch]) -> tuple[Level, Level] | None:
        """The levels of depth 2 and 3 of all contexts with some two latest bytes."""
        if (t := _columns(batches)) is None:
            return None
        keys = t["key"].view(np.uint64)
        order = np.argsort(keys)
        three = Level(keys[order], *(t[c][order] for c in NODE.names[1:]))
        return Level(*_sum_to(three.keys, 2, three.zeros, three.ones, three.log_weighted)), three

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (held := pair(batches)) is None:
            return
        two = held[0]
        keys, *sums = _sum_to(two.keys, 1, two.zeros, two.ones, two.log_weighted)
        yield _batch(keys, tuple(sums), NODE.names)

    nodes = cut(map_in_arrow(dealt.drop("near"), deep, NODE), "nodes")
    third = nodes.groupBy(parent.alias("key")).agg(*(F.sum(c).alias(c) for c in NODE.names[1:]))
    third = cut(third, "nodes")
    # At most 256 contexts with 255 nodes each.
    paired = third.repartition(parts, context("key", 2))
    first = map_in_arrow(paired, tops, NODE).groupBy("key").agg(*(F.sum(c).alias(c) for c in NODE.names[1:])).orderBy("key").toArrow()
    one = Level(first["key"].to_numpy().view(np.uint64), *(first[c].to_numpy() for c in NODE.names[1:]))
    root = Level(*_sum_to(one.keys, 0, one.zeros, one.ones, one.log_weighted))
    head = run_counts.sparkSession.sparkContext.broadcast([root, one])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (held := pair(batches)) is None:
            return
        keys = held[1].keys
        state = np.full(len(keys), 0.5), np.zeros(len(keys)), np.ones(len(keys))
        for depth, level in enumerate([*head.value, *held]):
            within = (keys >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)
            state = descend((within << np.uint64(8)) | (keys & np.uint64(0xFF)), level, *state)
        yield _batch(keys, state, STATE.names)

    # What is gathered down to depth 3, for each node of depth 4 below.
    above = map_in_arrow(paired, gathered, STATE).withColumnRenamed("key", "parent")
    above = nodes.select("key", parent.alias("parent")).join(above, "parent").select(context("key", NEAR).alias("near"), "key", *STATE.names[1:])
    both = run_counts.select(context("key", NEAR).alias("near"), "key", "n").unionByName(above, allowMissingColumns=True)

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (t := _columns(batches)) is None:
            return
        is_run = ~np.isnan(t["n"].astype(float))
        packed, n = t["key"].view(np.uint64)[is_run], t["n"][is_run].astype(np.int64)
        held = t["key"].view(np.uint64)[~is_run]
        order = np.argsort(held)
        at = np.searchsorted(held[order], _keys(packed, _nodes(packed)[0], NEAR))
        value = log10_run(packed, levels(packed, n, NEAR), NEAR, tuple(t[c][~is_run][order][at] for c in STATE.names[1:]))
        yield pa.RecordBatch.from_arrays([pa.array(packed.view(np.int64)), pa.array(n), pa.array(value)], COST.names)

    dealt = both.repartition(parts, "near").drop("near")
    lengths = cut(map_in_arrow(dealt, costs, COST), "lengths")
    discard(nodes, third)
    head.unpersist()
    return lengths


# Scoring --------------------------------------------------------------------------------------------------------


class Lookup:
    """64-bit keys and values in an open-addressed table, which each Python worker builds for itself."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.table = keys.view(np.uint64), values, None

    def __getstate__(self):
        return self.keys, self.values

    def __setstate__(self, state):
        (self.keys, self.values), self.table = state, None

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def build(self) -> None:
        self.bits = max(4, (3 * len(self.keys)).bit_length())
        n = 1 << self.bits
        self.table, self.entry = np.zeros(n, np.uint64), np.full(n, -1, np.int32)
        rest, slot = np.arange(len(self.keys), dtype=np.int32), self._slot(self.keys)
        while len(rest):
            free = self.entry[slot] < 0
            self.entry[slot[free]] = rest[free]
            placed = self.entry[slot] == rest
            self.table[slot[placed]] = self.keys[rest[placed]]
            rest, slot = rest[~placed], (slot[~placed] + 1) & (n - 1)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key whether it is here, and its value (0 if not)."""
        if self.table is None:
            self.build()
        slot = self._slot(keys)
        entry = self.entry[slot]
        right = (self.table[slot] == keys) & (entry >= 0)
        open_ = np.flatnonzero(~right & (entry >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.table) - 1)
            entry[open_] = self.entry[slot[open_]]
            ok = self.table[slot[open_]] == keys[open_]
            right[open_] = ok & (entry[open_] >= 0)
            open_ = open_[~ok & (entry[open_] >= 0)]
        return right, np.where(right, self.values[np.where(right, entry, 0)] if len(self.values) else 0, 0)


def _sum_by(x: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(x, dtype=float if x.dtype.kind == "f" else np.int64))
    end = np.cumsum(count)
    return total[end] - total[end - count]


def split(entries: DataFrame, most: int = HEAD_ROWS) -> tuple[Lookup, DataFrame]:
    """A table of the most frequent entries (key, n, value), `most` at the most, and the rest of them.

    Whole steps of the frequency (16 per doubling) are in the table or not, so it is the same in each run.
    """
    held = entries.withColumn("_step", F.floor(F.log2(F.col("n") + 1) * 16).cast("int"))
    left, least = most, 1 << 20
    for step, count in held.groupBy("_step").count().orderBy(F.desc("_step")).toArrow().to_pandas().itertuples(index=False):  # about 1000 rows at most
        if count > left:
            break
        left, least = left - count, step
    head = held.where(F.col("_step") >= least).select("key", "value").toArrow()
    return Lookup(head["key"].to_numpy(), head["value"].to_numpy()), held.where(F.col("_step") < least).drop("_step")


REST = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("m", T.LongType())]))
PASSED = T.StructType([T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("rest", REST)])


def _look_up(docs: DataFrame, words: Lookup, byte_runs: Lookup) -> DataFrame:
    """docs without text, with sums over what the tables hold of each text, and the rest: kind, key and how often (m)."""
    held = docs.sparkSession.sparkContext.broadcast({WORD: words, RUN: byte_runs})
    names = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*(docs.schema[c] for c in names), *PASSED.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PART_BYTES):
            said = Words(*texts_of(batch["text"]), NOT_SPACE, LOWER)
            of = {WORD: (said.hashes(), said.count), RUN: runs(batch["text"])}
            sums, missed = {}, []
            for kind, (keys, n) in of.items():
                here, value = held.value[kind].find(keys)
                sums[kind] = _sum_by(here.astype(np.int64), n), _sum_by(value.astype(float), n)
                out = np.flatnonzero(~here)
                row = np.repeat(np.arange(len(batch)), n)[out]
                order = np.lexsort((keys[out], row))
                row, key = row[order], keys[out][order]
                first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]))) if len(row) else np.zeros(0, int)
                missed.append((row[first], np.full(len(first), kind, np.int32), key[first], np.diff(np.append(first, len(row)))))
            row, kind, key, m = (np.concatenate(x) for x in zip(*missed, strict=True))
            order = np.argsort(row, kind="stable")
            at = np.searchsorted(row[order], np.arange(len(batch) + 1)).astype(np.int32)
            rest = pa.StructArray.from_arrays([pa.array(kind[order]), pa.array(key[order].view(np.int64)), pa.array(m[order].astype(np.int64))], ["kind", "key", "m"])
            rest = pa.ListArray.from_arrays(pa.array(at), rest)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(sums[WORD][0]), pa.array(sums[WORD][1]), pa.array(sums[RUN][1]), rest], schema.names)

    return map_in_arrow(docs, work, schema)


def score(docs: DataFrame, training: Column, text: str = "text") -> DataFrame:
    """The columns of docs but the text, with n_tokens, n_known, train_tokens, base_score and score, a row per row.

    Learns from rows for which `training` holds. base_score: sum over words and end of log10((c + 1) / (N + V + 1)), c
    the token's training count, N all training tokens, V distinct ones. score: log10 of the context trees' probability
    of the text's bytes and end, so -score / log10(2) / bytes is its code length per byte. Null and empty texts are an
    end alone. Without any training row every decision has probability 1/2. Rows are scored alone: repeated rows get
    equal scores. Columns of docs named as one of the new ones are replaced.
    """
    spark = docs.sparkSession
    lot = docs.select(F.col(text).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    counts = cut(count(lot), "counts")
    ends, words, distinct = counts.agg(
        F.sum(F.when(F.col("kind") == END, F.col("n"))), F.coalesce(F.sum(F.when(F.col("kind") == WORD, F.col("n"))), F.lit(0)), F.count(F.when(F.col("kind") == WORD, 1)),
    ).first()
    ends = ends or 0
    total, kinds = words + ends, distinct + (ends > 0)
    all_runs = counts.where(F.col("kind") == RUN)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-all_runs.count() // TREE_ROWS))
    lengths = code_lengths(all_runs, parts)
    vocabulary = counts.where(F.col("kind") == WORD).select("key", "n", F.log10(F.col("n") + 1.0).alias("value"))
    (some_words, other_words), (some_runs, other_runs) = split(vocabulary), split(lengths)
    new = {"n_tokens", "n_known", "train_tokens", "base_score", "score"}
    others = [c for c in docs.columns if c not in {text} | new]
    tokens = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1
    own = docs.select(*(F.col(c).alias(f"own_{k}") for k, c in enumerate(others)), tokens.alias("n_tokens"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    passed = cut(_look_up(own, some_words, some_runs), "passed")
    keyed = lambda df, kind: df.select(F.struct(F.lit(kind).alias("kind"), "key").alias("k"), "value")
    rest = passed.select("row", F.explode("rest").alias("r")).select("row", F.struct("r.kind", "r.key").alias("k"), "r.m")
    found = lookup(rest, "k", "row", keyed(other_words, WORD).unionByName(keyed(other_runs, RUN)))
    of = lambda kind, x: F.sum(F.when(F.col("k.kind") == kind, x).otherwise(F.lit(0)))
    more = found.groupBy("row").agg(of(WORD, F.col("m")).alias("_n"), of(WORD, F.col("m") * F.col("value")).alias("_base"), of(RUN, F.col("m") * F.col("value")).alias("_score"))
    whole = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return passed.drop("rest").join(more, "row", "left").select(
        *(F.col(f"own_{k}").alias(c) for k, c in enumerate(others)), "n_tokens",
        (whole("n_known", "_n") + int(ends > 0)).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (whole("base_score", "_base") + F.lit(float(np.log10(ends + 1))) - F.col("n_tokens") * F.lit(float(np.log10(total + kinds + 1)))).alias("base_score"), whole("score", "_score").alias("score"),
    )

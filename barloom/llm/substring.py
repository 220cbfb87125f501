"""Substring dedup with suffix trees over groups of suffixes that share a prefix.

A window is WINDOW consecutive words of one document; a word goes if a window over it also starts anywhere else. Of
the words from which the suffixes start, only anchors are indexed: each window belongs to its anchor, the place in it
whose PREFIX-word shingle has the least hash, which depends on the window's words alone, so equal windows have equal
anchors at the same place. Neighbouring windows of one anchor are one run of words. Then:

1. Suffixes whose prefix (the anchor's shingle) starts nowhere else are dropped: their windows are unique.
2. Equal runs are one leaf, with their number as its weight. A prefix with one leaf is a tree that is done: its windows
   are repeated if the weight is over 1. Words are gathered for the other prefixes alone.
3. Prefixes of up to TREE_ROWS leaves are grouped into tasks, a tree each: a task sorts its suffixes to the right of the
   anchor and reversed to the left of it, and the longest common prefixes of neighbours give the nodes. A window with d
   words left of its anchor is repeated if its node of depth WINDOW - d has weight over 1 within its node of depth d on
   the left.
4. Prefixes of more leaves are made longer, by PREFIX words a step, until the groups fit: their runs become suffixes from
   each window's first word, groups of weight 1 drop out, those that fit are trees whose nodes of depth WINDOW are the
   repeats, and the rest goes to the next step. A prefix that is the whole window is one node.
5. Repeated windows go back to the rows that have the run, and their words are removed.

Prefix hashes only decide what meets in a tree, which compares words. Runs, rows and lengthened prefixes are told apart
by 128 bits of hash of their text, words within a tree by 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import Words, cut, digests, discard, map_in_arrow, rolling, slices, texts_of, with_group

#: Words of the shortest prefix by which suffixes are parted, and by which prefixes grow.
PREFIX = 8
#: Leaves of one prefix up to which one tree holds them.
TREE_ROWS = 512
#: Suffixes that one task should hold, of many prefixes (about 1 kB each).
TASK_ROWS = 50_000

# A run's place is packed in a long: word of the anchor, windows' least and most words left of the anchor.
LONG, INT, BYTES = T.LongType(), T.IntegerType(), T.BinaryType()


def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


#: A row of documents (128 bits), a run's place in it, the anchor's prefix, the run (128 bits).
ANCHORS = _schema(r1=LONG, r2=LONG, place=LONG, key=LONG, c1=LONG, c2=LONG)
LEAVES = _schema(key=LONG, c1=LONG, c2=LONG, n=LONG, low=INT, high=INT, words=BYTES)
SUFFIXES = _schema(key=LONG, c1=LONG, c2=LONG, n=LONG, bit=LONG, words=BYTES)
MASKS = _schema(key=LONG, c1=LONG, c2=LONG, mask=LONG)
RUN = ["key", "c1", "c2"]


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    width, out = 1, x
    while 2 * width <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return out if width == n else np.minimum(out[: len(x) - n + 1], out[n - width :])


def anchors(h: np.ndarray, last: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows with the same anchor: the anchor's place, the first window's and the last window's.

    last: for each place, the words from it to its document's end. Of equal hashes in a window the rightmost counts.
    """
    starts = np.flatnonzero(last >= window)
    if not len(starts):
        return starts, starts, starts
    shingles, places = rolling(h, PREFIX), np.uint64((1 << 28) - 1)
    packed = (shingles & ~places) | (places - np.arange(len(shingles), dtype=np.uint64))
    owner = (places - (_least(packed, window - PREFIX + 1)[starts] & places)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)))
    return owner[new], starts[new], starts[np.append(new[1:], len(starts)) - 1]


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """ANCHORS of each run of docs (r1, r2, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(*texts_of(batch["text"]))
            h = words.hashes()
            at, first, end = anchors(h, words.first[1:][words.row] - np.arange(len(h)), window)
            if not len(at):
                continue
            held, start = words.joined()
            held, last = held.tobytes(), end + window - 1
            runs = digests([held[a:b] for a, b in zip(start[first].tolist(), (start[last] + words.end[last] - words.start[last]).tolist(), strict=True)])
            row = words.row[at]
            place = (at - words.first[row]) << 16 | (at - end) << 8 | (at - first)
            own = [batch[c].take(pa.array(row)) for c in ("r1", "r2")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(place), pa.array(rolling(h, PREFIX)[at].view(np.int64)), pa.array(runs[:, 0]), pa.array(runs[:, 1])], ANCHORS.names)

    return map_in_arrow(docs, work, ANCHORS)


def _fetch(wanted: DataFrame, window: int) -> DataFrame:
    """LEAVES with the words (their hashes) of wanted runs; wanted: text and runs, a list of key, c1, c2, n, place."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(*texts_of(batch["text"]))
            h, runs = words.hashes(), batch["runs"]
            runs, n = runs.flatten(), runs.value_lengths().to_numpy(zero_copy_only=False)
            place = runs.field("place").to_numpy()
            low, high = (place >> 8) & 255, place & 255
            at = (place >> 16) + np.repeat(words.first[:-1], n)
            held = [h[a:b].tobytes() for a, b in zip((at - high).tolist(), (at - low + window).tolist(), strict=True)]
            own = [runs.field(c) for c in (*RUN, "n")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(held, pa.binary())], LEAVES.names)

    return map_in_arrow(wanted, work, LEAVES)


def _depths(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of words in order as strings, and the words that each has in common with the one before (0 for the first)."""
    order = np.argsort(np.ascontiguousarray(rows).astype(">u8").view(f"S{8 * rows.shape[1]}").ravel(), kind="stable")
    held = rows[order]
    differ = np.concatenate([held[1:] != held[:-1], np.ones((max(len(held) - 1, 0), 1), bool)], axis=1)
    return order, np.append(np.zeros(min(1, len(rows)), int), differ.argmax(axis=1))


def _leaves(depths: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    """For each row the number of its node of that depth."""
    order, common = depths
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def repeated(words: list[np.ndarray], n: np.ndarray, low: np.ndarray, high: np.ndarray, window: int) -> np.ndarray:
    """Bit d of each leaf: whether its window with d words left of the anchor is in a node of weight over 1."""
    most = window - PREFIX
    right, left = np.zeros((len(words), window), np.uint64), np.zeros((len(words), most), np.uint64)
    for i, (w, k) in enumerate(zip(words, high.tolist(), strict=True)):
        right[i, : len(w) - k] = w[k:]
        left[i, :k] = w[:k][::-1]
    right, left = _depths(right), _depths(left)
    mask = np.zeros(len(words), np.int64)
    for d in range(most + 1):
        here = np.flatnonzero((low <= d) & (d <= high))
        node = _leaves(right, window - d)[here] * (len(words) + 1) + _leaves(left, d)[here]
        _, inverse = np.unique(node, return_inverse=True)
        mask[here] |= (np.bincount(inverse, n[here])[inverse] > 1).astype(np.int64) << d
    return mask


def _held(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    some = [b for b in batches if len(b)]
    return pa.Table.from_batches(some) if some else None


def _trees(leaves: DataFrame, parts: int, window: int) -> DataFrame:
    """MASKS of the repeated windows of leaves; those of one prefix meet in one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (t := _held(batches)) is None:
            return
        words = [np.frombuffer(b.as_buffer(), np.uint64) for b in t["words"]]
        mask = repeated(words, t["n"].to_numpy(), t["low"].to_numpy(), t["high"].to_numpy(), window)
        some = np.flatnonzero(mask)
        yield pa.RecordBatch.from_arrays([*(pa.array(t[c].to_numpy()[some]) for c in RUN), pa.array(mask[some])], MASKS.names)

    return map_in_arrow(leaves.repartition(parts, "key"), work, MASKS)


def _suffixes(leaves: DataFrame, window: int) -> DataFrame:
    """SUFFIXES: one from the first word of each window of the leaves, cut at the window; bit is the window's in its run."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (b, high) in enumerate(zip(batch["words"], batch["high"].to_pylist(), strict=True)):
                held = b.as_buffer().to_pybytes()
                rows += [(i, 1 << (high - k), held[8 * k : 8 * (k + window)]) for k in range(len(held) // 8 - window + 1)]
            own, bits, words = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(own, pa.int32())) for c in (*RUN, "n")), pa.array(bits, pa.int64()), pa.array(words, pa.binary())], SUFFIXES.names)

    return map_in_arrow(leaves, work, SUFFIXES)


def _forests(suffixes: DataFrame, parts: int, window: int) -> DataFrame:
    """MASKS of the suffixes under nodes of depth `window` and weight over 1; suffixes of one prefix meet in one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (t := _held(batches)) is None:
            return
        words = np.stack([np.frombuffer(b.as_buffer(), np.uint64) for b in t["words"]])
        node = _leaves(_depths(words), window)
        some = np.flatnonzero(np.bincount(node, t["n"].to_numpy())[node] > 1)
        yield pa.RecordBatch.from_arrays([pa.array(t[c].to_numpy()[some]) for c in (*RUN, "bit")], MASKS.names)

    return map_in_arrow(suffixes.repartition(parts, "prefix").select(*SUFFIXES.names), work, MASKS)


def _parts(rows: DataFrame) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))


def _longer(leaves: DataFrame, window: int, held: list[DataFrame]) -> list[DataFrame]:
    """MASKS of leaves with too many under one prefix, by prefixes that grow until groups fit; held: takes what was written."""
    held.append(todo := cut(_suffixes(leaves, window), "suffixes"))
    masks, depth = [], PREFIX
    while depth < window and not todo.isEmpty():
        depth = min(depth + PREFIX, window)
        keyed = todo.select(*SUFFIXES.names, F.md5(F.substring("words", 1, 8 * depth)).alias("prefix"))
        grouped = with_group(keyed, "prefix", "c1", {"kinds": (F.count(F.lit(1)), F.sum("kinds")), "weight": (F.sum("n"), F.sum("weight"))})
        held.append(grouped := cut(grouped.where("weight > 1"), "prefixes"))
        fits = grouped.where(F.col("kinds") <= TREE_ROWS)
        masks.append(_forests(fits, _parts(fits), window))
        todo = grouped.where(F.col("kinds") > TREE_ROWS)
    # Prefixes that are whole windows by now.
    return [*masks, todo.select(*RUN, F.col("bit").alias("mask"))]


def repeats(docs: DataFrame, window: int) -> DataFrame:
    """r1, r2 and marks (list of anchor's word `at` and `mask`, windows by words left of it) of rows with repeated windows.

    docs: r1, r2 (equal for rows that repeat both doc_id and text alone), text.
    """
    # Runs and texts meet by row; texts too short for a window stay behind.
    long = docs.where(F.length("text") >= 2 * window - 1)
    every = cut(_anchor_rows(long, window), "anchors")
    keys = cut(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "keys")
    some = cut(every.join(keys, "key", "left_semi"), "shared")
    discard(every, keys)
    runs = cut(some.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("r1", "r2", "place")).alias("one")), "runs")
    kinds = cut(runs.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "kinds")
    wanted = runs.join(kinds, "key").select(*RUN, "n", "one.r1", "one.r2", "one.place")
    wanted = wanted.groupBy("r1", "r2").agg(F.collect_list(F.struct(*RUN, "n", "place")).alias("runs"))
    leaves = cut(_fetch(wanted.join(long, ["r1", "r2"]).select("text", "runs"), window).join(kinds, "key"), "leaves")
    small, large = leaves.where(F.col("kinds") <= TREE_ROWS).drop("kinds"), leaves.where(F.col("kinds") > TREE_ROWS).drop("kinds")
    # Leaves of a frequent prefix lie together here; no task should work out most of the suffixes.
    held, parts = [], _parts(leaves)
    longer = _longer(large.repartition(parts, "c1"), window, held)
    low, high = F.shiftright("one.place", 8).bitwiseAND(F.lit(255)).cast("int"), F.col("one.place").bitwiseAND(F.lit(255)).cast("int")
    masks = runs.where("n > 1").withColumns({"low": low, "high": high}).select(*RUN, F.expr("shiftleft(1L, high + 1) - shiftleft(1L, low)").alias("mask"))
    for more in (_trees(small, parts, window), *longer):
        masks = masks.unionByName(more)
    masks = cut(masks.groupBy(*RUN).agg(F.bit_or("mask").alias("mask")), "masks")
    discard(runs, kinds, leaves, *held)
    marked = some.join(masks, RUN).groupBy("r1", "r2", F.shiftright("place", 16).alias("at")).agg(F.bit_or("mask").alias("mask"))
    marks = cut(marked.groupBy("r1", "r2").agg(F.collect_list(F.struct("at", "mask")).alias("marks")), "marks")
    discard(some, masks)
    return marks


def covered(n: int, at: np.ndarray, mask: np.ndarray, window: int) -> np.ndarray:
    """Which of a document's n words are in a marked window."""
    edge = np.zeros(n + 1, np.int64)
    for d in range(window - PREFIX + 1):
        start = at[(mask >> d) & 1 == 1] - d
        np.add.at(edge, start, 1)
        np.add.at(edge, start + window, -1)
    return np.cumsum(edge)[:-1] > 0


REMOVED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


def remove(docs: DataFrame, window: int = 35, text: str = "text", doc_id: str = "doc_id", digest_only: bool = False) -> DataFrame:
    """docs with n_words, n_removed and kept (the words that stay, joined by one space).

    Words are runs of anything but ASCII white space, unchanged. Windows are judged on the input, not on what is left,
    so each copy of a repeated passage goes. Null, empty and short texts have no window and lose nothing. Rows that
    repeat doc_id and text count as different places, so their windows are repeated. Extra columns stay, unless they are
    named as one of the new ones.
    digest_only: kept holds the SHA-256 of the words that stay, in lower-case hex, in place of them.
    """
    if not PREFIX < window <= 64:
        raise ValueError(f"a window has {PREFIX + 1} to 64 words")
    docs = docs.drop("n_words", "n_removed", "kept")
    key = ["_barloom_r1", "_barloom_r2"]
    held = docs.withColumns(dict(zip(key, row_key(doc_id, text))))
    marks = repeats(held.select(F.col(key[0]).alias("r1"), F.col(key[1]).alias("r2"), F.col(text).alias("text")), window).toDF(*key, "_barloom_marks")
    # A left join keeps all rows; texts meet the marks of their own row only.
    joined = held.join(marks, key, "left").drop(*key)
    names = [c for c in joined.columns if c != "_barloom_marks"]
    schema = T.StructType([*docs.schema.fields, *REMOVED.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            data, at = texts_of(batch[text])
            words = Words(data, at)
            lists = batch["_barloom_marks"]
            runs, n = lists.flatten(), np.diff(lists.offsets.to_numpy()) * ~lists.is_null().to_numpy(zero_copy_only=False)
            place, mask, end = runs.field("at").to_numpy(), runs.field("mask").to_numpy(), np.cumsum(n)
            held, lost, kept = data.tobytes(), [], []
            for row in range(len(batch)):
                gone = covered(words.count[row], place[end[row] - n[row] : end[row]], mask[end[row] - n[row] : end[row]], window) if n[row] else None
                lost.append(int(gone.sum()) if n[row] else 0)
                if n[row]:
                    stay = np.flatnonzero(~gone) + words.first[row]
                    left = b" ".join([held[a:b] for a, b in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)])
                else:
                    left = b" ".join(held[at[row] : at[row + 1]].split())
                kept.append(hashlib.sha256(left).hexdigest() if digest_only else left.decode())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(words.count, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], schema.names)

    return map_in_arrow(joined, work, schema)


def row_key(doc_id: str, text: str) -> tuple[Column, Column]:
    """128 bits of hash of a row."""
    own = F.col(doc_id).cast("string")
    return F.xxhash64(own, F.col(text)), F.xxhash64(F.col(text), own, F.lit(1))

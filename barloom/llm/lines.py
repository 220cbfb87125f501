"""Line dedup by pairwise alignment: pairs by shared line hashes, patience diff, common blocks go from the later one.

The result is that of aligning each document with every earlier one, without all those pairs. A line in up to RARE
documents pairs each holder with all earlier ones; a line in more pairs each holder with the earliest. What that leaves
is worked out on outlines: a document's frequent and blank lines, each run of others as one gap. Documents that share
no rare line align as their outlines do, so outlines with a run of least_words words in common are aligned once, however
many documents have them, where a document still has such a run. Only line hashes are joined and aligned; texts meet the
lines they lose once, at the end.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import cut, lookup, map_in_arrow

#: Documents with a line up to which all pairs of them are aligned.
RARE = 8
#: A null doc_id comes after all others.
LAST = (1 << 63) - 1


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places (i in a, j in b), rising in both, of lines that a patience diff aligns."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i >= m or j >= n:
            continue
        once, other = Counter(a[i:m]), Counter(b[j:n])
        place = {x: j + k for k, x in enumerate(b[j:n]) if other[x] == 1}
        pairs = [(i + k, place[x]) for k, x in enumerate(a[i:m]) if once[x] == 1 and x in place]
        # The longest rising run of places in b.
        tails, top, back = [], [], [-1] * len(pairs)
        for k, (_, y) in enumerate(pairs):
            at = bisect_left(tails, y)
            back[k] = top[at - 1] if at else -1
            tails[at : at + 1], top[at : at + 1] = [y], [k]
        chain, k = [], top[-1] if top else -1
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        for x, y in chain[::-1]:
            if x >= i and y >= j:
                todo.append((i, x, j, y))
                out.append((x, y))
                i, j = x + 1, y + 1
        if chain:
            todo.append((i, m, j, n))
    return sorted(out)


def blocks(pairs: list[tuple[int, int]], words: list[int], least: int) -> list[int]:
    """Places in b of aligned blocks (neighbours in both) that have at least so many words together."""
    out, k = [], 0
    while k < len(pairs):
        end = k + 1
        while end < len(pairs) and pairs[end][0] == pairs[end - 1][0] + 1 and pairs[end][1] == pairs[end - 1][1] + 1:
            end += 1
        own = [y for _, y in pairs[k:end]]
        if sum(words[y] for y in own) >= least:
            out += own
        k = end
    return out


def runs(words: list[int], usable: list[bool], least: int) -> set[tuple[int, int]]:
    """Shortest runs (first and last place) of usable lines with at least so many words, from and up to each line."""
    n, sums = len(words), [0, *accumulate(words)]
    after, before, out = [n] * (n + 1), [-1] * (n + 1), set()  # the next and the last place that isn't usable
    for k in range(n - 1, -1, -1):
        after[k] = after[k + 1] if usable[k] else k
    for k in range(n):
        before[k] = before[k - 1] if usable[k] else k
    for k in range(n):
        end = max(k, bisect_left(sums, sums[k] + least) - 1)
        if end < after[k]:
            out.add((k, end))
        begin = min(k, bisect_right(sums, sums[k + 1] - least) - 1)
        if begin > before[k]:
            out.add((begin, k))
    return out


def outline(seq: list[int], words: list[int], often: set[int]) -> tuple[list[int | None], list[int]]:
    """The frequent and blank lines, with None for each run of other lines, and the place of each (the first of a run)."""
    out, at = [], []
    for k, (x, n) in enumerate(zip(seq, words, strict=True)):
        own = x if n == 0 or x in often else None
        if own is not None or not out or out[-1] is not None:
            out.append(own)
            at.append(k)
    return out, at


SHORT = T.StructType([
    T.StructField("d", T.LongType()), T.StructField("h", T.LongType()), T.StructField("seq", T.ArrayType(T.LongType())),
    T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("at", T.ArrayType(T.IntegerType())),
])
LOST = T.StructType([T.StructField("d", T.LongType()), T.StructField("h", T.LongType()), T.StructField("lost", T.ArrayType(T.IntegerType()))])
OUTLINE = T.StructType([
    T.StructField("d", T.LongType()), T.StructField("h", T.LongType()), T.StructField("sig", T.LongType()), T.StructField("lines", T.ArrayType(T.LongType())),
    T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("at", T.ArrayType(T.IntegerType())),
    T.StructField("run", T.ArrayType(T.LongType())), T.StructField("lo", T.ArrayType(T.IntegerType())), T.StructField("hi", T.ArrayType(T.IntegerType())),
])
TAKEN = T.StructType([T.StructField("sig", T.LongType()), T.StructField("other_sig", T.LongType()), T.StructField("places", T.ArrayType(T.IntegerType()))])


def _few(batches: Iterator[pa.RecordBatch], rows: int = 16) -> Iterator[pa.RecordBatch]:
    """The same rows, so few at once that their lists of lines, made into Python objects, stay small."""
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield batch.slice(lo, rows)


def shortened(docs: DataFrame) -> DataFrame:
    """SHORT of docs (id, seq, words, own): of each run of lines that no other document has, only the first.

    own: the lines that others have too. What is left out is like no line of another document, and one line of its run
    still parts its neighbours, so documents align as before. `at` gives the places in the whole document.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            seqs, words, ats = [], [], []
            for seq, n, own in zip(batch["seq"], batch["words"], batch["own"], strict=True):
                x, n = seq.values.to_numpy(), n.values.to_numpy()
                held = (n == 0) | np.isin(x, own.values.to_numpy())
                held[1:] |= held[:-1]  # the first of a run that is left out
                held[:1] = True
                at = np.flatnonzero(held)
                seqs.append(x[at])
                words.append(n[at])
                ats.append(at)
            yield pa.RecordBatch.from_arrays([batch["d"], batch["h"], pa.array(seqs, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32())), pa.array(ats, pa.list_(pa.int32()))], SHORT.names)

    return map_in_arrow(docs.select("id.d", "id.h", "seq", "words", "own"), work, SHORT)


def outlines(docs: DataFrame, least_words: int) -> DataFrame:
    """OUTLINE of docs (id, seq, words, often) that have a run of frequent lines; runs are by hash and places in the document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            rows = []
            for d, h, seq, words, often in zip(*(batch[c].to_pylist() for c in ("d", "h", "seq", "words", "often")), strict=True):
                often = set(often)
                found = sorted(runs(words, [n == 0 or x in often for x, n in zip(seq, words, strict=True)], least_words))
                if not found:
                    continue
                held, at = outline(seq, words, often)
                key = lambda part: xxhash.xxh64_intdigest(repr(part)) - (1 << 63)
                rows.append((d, h, key(held), held, [0 if x is None else words[k] for x, k in zip(held, at, strict=True)], at, [key(seq[a : b + 1]) for a, b in found], [a for a, _ in found], [b for _, b in found]))
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64())] + [pa.list_(pa.int32())] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], OUTLINE.names)

    return map_in_arrow(docs.select("id.d", "id.h", "seq", "words", "often"), work, OUTLINE)


def left_over(held: DataFrame, lost: DataFrame, few: DataFrame, least_words: int) -> DataFrame:
    """LOST of what documents (held: OUTLINE) lose to earlier ones beyond lost (d, h, taken): by outlines, each pair of them once.

    few: pairs (id, to) of documents that share a rare line. Outlines do not tell how these align, and they were aligned.
    """
    held = held.withColumn("id", F.struct("d", "h"))
    some = cut(held.groupBy("sig").agg(F.min("id").alias("first"), F.first("lines").alias("lines"), F.first("words").alias("words"), F.first("run").alias("run")), "outlines")
    gone = F.coalesce("taken", F.array().cast("array<int>"))
    stays = lambda r: F.size(F.array_except(F.sequence(r["lo"], r["hi"]), gone)) > 0
    todo = held.join(lost, ["d", "h"], "left").select("id", "sig", "at", gone.alias("gone"), F.filter(F.arrays_zip("run", "lo", "hi"), stays)["run"].alias("open"))
    todo = cut(todo.where(F.size("open") > 0), "open")
    wanted = todo.select("id", "sig", F.explode("open").alias("run")).groupBy("sig", "run").agg(F.max("id").alias("last"))
    offered = some.select(F.col("sig").alias("other_sig"), "first", F.explode(F.array_distinct("run")).alias("run"))
    both = wanted.join(offered, "run").where("first < last").select("sig", "other_sig").distinct()
    both = both.join(some.select("sig", "lines", "words"), "sig").join(some.select(F.col("sig").alias("other_sig"), F.col("lines").alias("other")), "other_sig")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            b, a, n = (batch[c].to_pylist() for c in ("lines", "other", "words"))
            # A gap is like no line of the other document.
            taken = [blocks(patience(["gap" if v is None else v for v in x], y), w, least_words) for x, y, w in zip(a, b, n, strict=True)]
            some = np.flatnonzero([bool(x) for x in taken])
            yield pa.RecordBatch.from_arrays([batch["sig"].take(pa.array(some)), batch["other_sig"].take(pa.array(some)), pa.array([taken[k] for k in some], pa.list_(pa.int32()))], TAKEN.names)

    taken = map_in_arrow(both.select("sig", "other_sig", "lines", "words", "other"), work, TAKEN)
    taken = cut(taken.join(some.select(F.col("sig").alias("other_sig"), "first"), "other_sig"), "taken")
    # What a document can lose, each set of places once, with the earliest document that takes it.
    least = taken.groupBy("sig", "places").agg(F.min("first").alias("to"))
    lines = F.transform("places", lambda k: F.col("at")[k])
    could = todo.join(least, "sig").where("to < id").withColumn("lost", lines).where(F.size(F.array_except("lost", "gone")) > 0)
    could = cut(could.select("id", "sig", "places", "lost", "to"), "could")
    free = could.join(few, ["id", "to"], "left_anti").select("id", "lost")
    # Where that one shares a rare line, any other document of these outlines.
    tied = could.join(few, ["id", "to"], "left_semi").drop("to").join(taken.select("sig", "places", "other_sig"), ["sig", "places"])
    tied = tied.join(held.select(F.col("sig").alias("other_sig"), F.col("id").alias("to")), "other_sig").where("to < id")
    tied = tied.join(few, ["id", "to"], "left_anti").select("id", "lost").distinct()
    return free.unionByName(tied).select("id.d", "id.h", "lost")


def remove(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rare: int = RARE, least_words: int = 5) -> DataFrame:
    """docs with n_lines, n_removed, n_partners (earlier documents, of those aligned with it, that took lines from it) and kept (the lines left).

    Lines are parted by "\\n"; lines of white space alone start no pair, but can lie in an aligned block. A block goes
    if it has least_words words. Of two documents the later has the larger doc_id; a null doc_id comes last, and equal
    doc_ids are in order of a hash of their texts. Rows that repeat doc_id and text are one document: none loses lines to the other. Null
    text has no lines, empty text one empty line; neither loses anything. Extra columns stay, unless they are named as
    one of the new ones.
    """
    docs = docs.drop("n_lines", "n_removed", "n_partners", "kept")
    held = docs.withColumns({"_barloom_d": F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)), "_barloom_h": F.xxhash64(F.col(text))})
    lines = F.split(F.col(text), "\n", -1)
    words = F.transform(lines, lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")))
    seqs = cut(held.where(F.col(text).isNotNull()).select(F.struct(F.col("_barloom_d").alias("d"), F.col("_barloom_h").alias("h")).alias("id"), F.transform(lines, lambda x: F.xxhash64(x)).alias("seq"), words.alias("words")).dropDuplicates(["id"]), "lines")
    some = seqs.select("id", F.explode(F.arrays_zip("seq", "words")).alias("x")).where("x.words > 0").select("id", F.col("x.seq").alias("line")).distinct()
    some = cut(some, "held")
    shared = cut(some.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1"), "shared")
    held_by = cut(lookup(some, "line", "id", shared), "holders")
    far = held_by.where((F.col("n") > rare) & (F.col("first") < F.col("id"))).select("id", F.col("first").alias("to"))
    few = held_by.where(F.col("n") <= rare).groupBy("line").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    few = few.select(F.posexplode("ids").alias("k", "id"), "ids").select("id", F.explode(F.slice("ids", F.lit(1), F.col("k"))).alias("to"))
    few = cut(few.distinct(), "few")
    pairs = far.unionByName(few).distinct()
    # A document may be the earliest holder for very many.
    own = held_by.groupBy("id").agg(F.collect_list("line").alias("own"))
    short = cut(shortened(seqs.join(own, "id")), "short").withColumn("id", F.struct("d", "h"))
    early = lookup(pairs, "to", "id", short.select(F.col("id").alias("to"), F.col("seq").alias("other")))
    both = early.select("id", "other").join(short, "id").select("d", "h", "seq", "words", "at", "other")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            b, a, n, at = (batch[c].to_pylist() for c in ("seq", "other", "words", "at"))
            lost = [[place[k] for k in blocks(patience(x, y), w, least_words)] for x, y, w, place in zip(a, b, n, at, strict=True)]
            some = np.flatnonzero([bool(x) for x in lost])
            yield pa.RecordBatch.from_arrays([batch["d"].take(pa.array(some)), batch["h"].take(pa.array(some)), pa.array([lost[k] for k in some], pa.list_(pa.int32()))], LOST.names)

    lost = cut(map_in_arrow(both, work, LOST), "lost")
    often = held_by.where(F.col("n") > rare).groupBy("id").agg(F.collect_list("line").alias("often"))
    taken = lost.groupBy("d", "h").agg(F.array_distinct(F.flatten(F.collect_list("lost"))).alias("taken"))
    lost = lost.unionByName(left_over(cut(outlines(seqs.join(often, "id"), least_words), "outline"), taken, few, least_words))
    lost = lost.groupBy(F.col("d").alias("_barloom_d"), F.col("h").alias("_barloom_h")).agg(F.array_distinct(F.flatten(F.collect_list("lost"))).alias("_barloom_lost"), F.count(F.lit(1)).alias("_barloom_partners"))
    joined = held.join(lost, ["_barloom_d", "_barloom_h"], "left")
    kept = F.filter(lines, lambda _, k: ~F.coalesce(F.array_contains("_barloom_lost", k), F.lit(False)))
    return joined.select(
        *docs.columns, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("_barloom_lost"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("_barloom_partners", F.lit(0)).cast("long").alias("n_partners"), F.array_join(kept, "\n").alias("kept"),
    )

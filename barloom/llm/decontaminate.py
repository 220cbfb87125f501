"""Benchmark decontamination with suffix arrays over shards of the training text.

Each task builds the suffix array of the words of its rows, a shard of some MB at a time, in order of as many words as a
window has or more, and binary-searches every suffix of the benchmark that has a whole window (10 words, or an item of
fewer) in it: the range of suffixes that begin with the window are its occurrences. Where one begins, the document's suffix is searched in the suffix array of the
benchmark, which gives the longest verbatim match there, its item and place. The benchmark is sent to the tasks in
blocks of a bounded size, one after another; documents are never shuffled for one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import ALNUM, LOWER, Words, cut, discard, map_in_arrow, slices, texts_of

#: UTF-8 bytes of benchmark text in a block, which is broadcast (about 12 bytes for each, and 60 while it is made).
BLOCK_BYTES = 4 << 20


def suffix_array(h: np.ndarray, last: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Places in order of their suffixes, by word hashes; an end comes before any word.

    h: word hashes; last: for each place, the words from it to its text's end. Ranks by 1, 2, 4 ... words: those with
    a rank of their own are done, and the others are put in order by the rank of what follows. Whole suffixes are
    compared, equal ones in order of place; or their first `depth` words at least.
    """
    n, kind = len(h), "stable" if depth is None else None
    order = np.argsort(h, kind=kind)
    place = np.arange(n)

    def ranks(step: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(step, at, 0))

    rank = np.empty(n, np.int64)
    rank[order] = ranks(np.append(True, h[order][1:] != h[order][:-1])[:n], place)
    k, longest = 1, last.max(initial=0)
    while k < (longest if depth is None else min(longest, depth)):
        held = rank[order]
        new = np.append(True, held[1:] != held[:-1])
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        at = order[tied]
        second = np.zeros(len(at), np.int64)
        far = np.flatnonzero(last[at] > k)
        second[far] = rank[at[far] + k] + 1
        key = rank[at] * (n + 1) + second
        sort = np.argsort(key, kind=kind)
        key = key[sort]
        order[tied] = at[sort]
        split = np.append(True, key[1:] != key[:-1])
        if split.sum() == new[tied].sum():
            break
        rank[at[sort]] = ranks(split, tied)
        k *= 2
    return order


class Suffixes:
    """A text of words (hashes, words to the end of each) with its suffix array; ranges of it are narrowed word by word."""

    def __init__(self, h: np.ndarray, last: np.ndarray, depth: int | None = None):
        self.h, self.last, self.order = h, last, suffix_array(h, last, depth)
        self.heads = h[self.order]

    def first(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of suffixes that begin with each word."""
        return np.searchsorted(self.heads, word, "left"), np.searchsorted(self.heads, word, "right")

    def narrow(self, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Within each range, whose suffixes agree in `depth` words, those that go on with the word: binary search."""

        def bound(before: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
            a, b = lo.copy(), hi.copy()
            while len(live := np.flatnonzero(a < b)):
                mid = (a[live] + b[live]) // 2
                at = self.order[mid]
                ends = self.last[at] <= depth
                less = ends | before(self.h[np.where(ends, 0, at + depth)], word[live])
                a[live[less]], b[live[~less]] = mid[less] + 1, mid[~less]
            return a

        return bound(np.less), bound(np.less_equal)


class Items:
    """A block of benchmark items: suffix array, distinct windows (a place and length each) and the items of each."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        items = sorted(items, key=lambda x: (x[0] is None, str(x[0]), x[1] or ""))
        words = Words(*texts_of(pa.array([text for _, text in items], pa.string())), ALNUM, LOWER)
        self.size, self.ids, self.row, self.begin = size, [None if i is None else str(i) for i, _ in items], words.row, words.first[:-1]
        self.suffixes = Suffixes(words.hashes(), words.first[1:][words.row] - np.arange(len(words.row)))
        last = self.suffixes.last
        whole = words.first[:-1][(words.count > 0) & (words.count < size)]
        at = np.concatenate([self.suffixes.order[last[self.suffixes.order] >= size], whole])
        length = np.minimum(last[at], size)
        held = np.zeros((len(at), size + 1), np.uint64)
        held[:, size] = length
        for k in range(size):
            far = length > k
            held[far, k] = self.suffixes.h[at[far] + k]
        _, one, window = np.unique(held, axis=0, return_index=True, return_inverse=True)
        self.at, self.length = at[one], length[one]
        # Windows in order, the items of each without repeats.
        pair = np.unique(np.stack([window.ravel(), words.row[at]]), axis=1) if len(at) else np.zeros((2, 0), int)
        self.of, self.edges = pair[1], np.searchsorted(pair[0], np.arange(len(one) + 1))

    def occurrences(self, shard: Suffixes) -> tuple[np.ndarray, np.ndarray]:
        """All (place in the shard, window)."""
        live = np.arange(len(self.at))
        lo, hi = shard.first(self.suffixes.h[self.at])
        places, found, depth = [np.zeros(0, int)], [np.zeros(0, int)], 1
        while True:
            some = hi > lo
            live, lo, hi = live[some], lo[some], hi[some]
            done = self.length[live] == depth
            n = (hi - lo)[done]
            places.append(shard.order[np.repeat(lo[done] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())] if n.sum() else np.zeros(0, int))
            found.append(np.repeat(live[done], n))
            live, lo, hi = live[~done], lo[~done], hi[~done]
            if not len(live):
                return np.concatenate(places), np.concatenate(found)
            lo, hi = shard.narrow(lo, hi, depth, self.suffixes.h[self.at[live] + depth])
            depth += 1

    def longest(self, shard: Suffixes, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the shard the length of the longest match with any item, and where in the block it begins."""
        length, at = np.zeros(len(places), int), np.zeros(len(places), int)
        live, depth = np.arange(len(places)), 0
        lo, hi = self.suffixes.first(shard.h[places])
        while True:
            some = hi > lo
            live, lo, hi = live[some], lo[some], hi[some]
            depth += 1
            length[live], at[live] = depth, self.suffixes.order[lo]
            on = shard.last[places[live]] > depth
            live, lo, hi = live[on], lo[on], hi[on]
            if not len(live):
                return length, at
            lo, hi = self.suffixes.narrow(lo, hi, depth, shard.h[places[live] + depth])


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])
MATCH = T.StructType([*SPAN.fields, T.StructField("item", T.StringType()), T.StructField("item_start", T.IntegerType())])
N_WORDS = T.StructField("n_words", T.LongType())
HITS = [T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("matches", T.ArrayType(MATCH))]


def _lists(row: np.ndarray, rows: int, values: pa.Array) -> pa.Array:
    """values, in order of row, as a list for each row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), values)


def _hits(words: Words, items: Items) -> list[pa.Array]:
    """HITS of each row."""
    rows, h = len(words.count), words.hashes()
    shard = Suffixes(h, words.first[1:][words.row] - np.arange(len(h)), items.size)
    places, found = items.occurrences(shard)
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, places, 1)
    np.add.at(cover, places + items.length[found], -1)
    # Rows are apart, also where one ends and the next begins with hits.
    hit = np.cumsum(cover)[:-1] > 0
    start = np.flatnonzero(hit & (np.append(False, ~hit[:-1]) | np.append(True, words.row[1:] != words.row[:-1])[: len(h)]))
    end = np.flatnonzero(hit & (np.append(~hit[1:], True) | np.append(words.row[1:] != words.row[:-1], True)[: len(h)])) + 1
    place = lambda at: pa.array((at - words.first[words.row[at]]).astype(np.int32))
    spans = pa.StructArray.from_arrays([place(start), pa.array((end - start).astype(np.int32))], SPAN.names)

    row, window = np.unique(np.stack([words.row[places], found]), axis=1) if len(places) else (np.zeros(0, int),) * 2
    n = np.diff(items.edges)[window]
    item = items.of[np.repeat(items.edges[window] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())] if len(window) else np.zeros(0, int)
    owner = np.repeat(row, n)
    # Items are in order of their ids.
    pair = np.unique(np.stack([owner, item]), axis=1) if len(item) else np.zeros((2, 0), int)
    names = [items.ids[i] for i in pair[1].tolist()]
    first = [k == 0 or names[k] != names[k - 1] or pair[0][k] != pair[0][k - 1] for k in range(len(names))]
    names, owner = [x for x, f in zip(names, first, strict=True) if f], pair[0][np.array(first, bool)]

    at = np.unique(places)
    length, of = items.longest(shard, at)
    # A match within an earlier one of its row is not its own.
    reach = np.maximum.accumulate(at + length) if len(at) else at
    own = np.flatnonzero(np.append(True, (at + length)[1:] > reach[:-1])[: len(at)] | np.append(True, words.row[at[1:]] != words.row[at[:-1]])[: len(at)])
    at, length, of = at[own], length[own], of[own]
    matches = pa.StructArray.from_arrays([
        place(at), pa.array(length.astype(np.int32)), pa.array([items.ids[i] for i in items.row[of].tolist()], pa.string()), pa.array((of - items.begin[items.row[of]]).astype(np.int32)),
    ], MATCH.names)
    return [_lists(words.row[start], rows, spans), _lists(owner, rows, pa.array(names, pa.string())), _lists(words.row[at], rows, matches)]


def find(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, clean_only: bool = False) -> DataFrame:
    """docs with n_words, spans, items and matches.

    spans: runs of document words inside an occurrence of a window (start, length). items: ids of the items with
    occurring windows, sorted as strings, a null id last. matches: the longest verbatim match from each place where a
    window occurs, but those within an earlier one: start, length, item, item_start; of several items with the same
    longest match one is named.

    A window is `size` consecutive words of an item, or a whole item of fewer but some. Words are lower-cased (A-Z)
    runs of digits, letters and characters beyond ASCII. Null and empty texts have no words. A benchmark without words
    marks nothing. Each row is judged alone, so repeated rows get equal results. Columns of docs named as one of the
    new ones are replaced. clean_only: drop rows with a span instead, and add no columns.
    """
    lot = benchmark.select(F.col(item).cast("string").alias("id"), F.col(item_text).alias("text")).distinct()
    total = lot.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_bytes))
    docs = docs if clean_only else docs.drop(N_WORDS.name, *(f.name for f in HITS))
    if blocks == 1:
        return _judged(docs, _sent(lot, size), text, clean_only)
    # One block after another; what each finds is small and meets the rows by two hashes of the text at the end.
    key = ["_barloom_t1", "_barloom_t2"]
    held = docs.withColumns({key[0]: F.xxhash64(F.col(text)), key[1]: F.xxhash64(F.lit(1), F.col(text))})
    slim, found = held.select(*key, F.col(text).alias("text")), []
    for k in range(blocks):
        items = _sent(lot.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k), size)
        found.append(cut(_judged(slim, items, "text", False).where(F.size("spans") > 0).drop("text", N_WORDS.name), "hits"))
        items.unpersist()
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    if clean_only:
        return held.join(hits, key, "left_anti").drop(*key)
    hits = cut(hits.groupBy(*key).agg(*(F.flatten(F.collect_list(f.name)).alias(f.name) for f in HITS)), "hits")
    discard(*found)
    none = lambda f: F.coalesce(f.name, F.array().cast(f.dataType))
    names = {"spans": _union(none(HITS[0])), "items": F.array_sort(F.array_distinct(none(HITS[1]))), "matches": _widest(none(HITS[2]))}
    n_words = F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    return held.join(hits, key, "left").select(*docs.columns, n_words.alias(N_WORDS.name), *(c.alias(n) for n, c in names.items()))


def _union(spans: Column) -> Column:
    """Spans of which none overlap or touch."""
    end = lambda s: s["start"] + s["length"]
    grown = lambda out, s: F.struct(F.element_at(out, -1)["start"].alias("start"), (F.greatest(end(F.element_at(out, -1)), end(s)) - F.element_at(out, -1)["start"]).alias("length"))
    step = lambda out, s: F.when((F.size(out) > 0) & (s["start"] <= end(F.try_element_at(out, F.lit(-1)))), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(grown(out, s)))).otherwise(F.concat(out, F.array(s)))
    return F.aggregate(F.sort_array(spans), F.array().cast(HITS[0].dataType), step)


def _widest(matches: Column) -> Column:
    """Matches that are not within an earlier one, the longest first of those from one place."""
    keyed = F.transform(matches, lambda m: F.struct(m["start"].alias("a"), (-m["length"]).alias("b"), m["item"].alias("c"), m["item_start"].alias("d")))
    step = lambda s, m: F.when(m["a"] - m["b"] > s["reach"], F.struct((m["a"] - m["b"]).alias("reach"), F.concat(s["out"], F.array(F.struct(m["a"].alias("start"), (-m["b"]).alias("length"), m["c"].alias("item"), m["d"].alias("item_start")))).alias("out"))).otherwise(s)
    return F.aggregate(F.sort_array(keyed), F.struct(F.lit(-1).alias("reach"), F.array().cast(HITS[2].dataType).alias("out")), step, lambda s: s["out"])


def _sent(lot: DataFrame, size: int):
    return lot.sparkSession.sparkContext.broadcast(Items([(r["id"], r["text"]) for r in lot.collect()], size))


def _judged(docs: DataFrame, items, text: str, clean_only: bool) -> DataFrame:
    """One block of the benchmark against all rows."""
    schema = docs.schema if clean_only else T.StructType([*docs.schema.fields, N_WORDS, *HITS])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            words = Words(*texts_of(batch[text]), ALNUM, LOWER)
            hits = _hits(words, items.value)
            if clean_only:
                yield batch.filter(pa.array(np.diff(hits[0].offsets.to_numpy()) == 0))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words.count, pa.int64()), *hits], schema.names)

    return map_in_arrow(docs, work, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs without any word inside an occurrence of a benchmark window."""
    return find(docs, benchmark, clean_only=True, **options)

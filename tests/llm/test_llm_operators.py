"""Each operator against SQL or a brute-force version, and on nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import binascii
import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from words_of import words
from pyspark.sql import functions as F
from util import assert_same

from barloom.llm import chat, ctw, decontaminate, exact_dedup, lines, mixing, quality, simhash, substring, warc
from barloom.llm.common import scratch, texts_of
from barloom.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert assert_same(QUERIES[name](spark, SMALL), ORACLES[name], SMALL) > 0


def small_documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


# 1 ---------------------------------------------------------------------------------------------------------------------


def test_chat_rotation(spark):
    said = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", ""), (1, 3, "ann", None), (1, 3, "ann", None), (None, 0, None, "x"), (2, 0, "system", "alone")]
    turns = spark.createDataFrame([(*s, "mine") for s in said], "conv_id LONG, turn INT, role STRING, text STRING, perspective STRING")
    got = {(r.conv_id, r.perspective): r for r in chat.rotate(turns).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "")}
    ann = got[1, "ann"]
    assert ann.text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [ann.text[m.start : m.start + m.length] for m in ann.mask] == ["hi < |im_end|><|im_end|>\n", "<|im_end|>\n"]
    assert [got[1, "bob"].text[m.start : m.start + m.length] for m in got[1, "bob"].mask] == ["<|im_end|>\n"]
    assert chat.rotate(turns.where("false")).count() == 0


def test_long_chats_come_in_parts(spark):
    turns = spark.range(1000).select(F.lit(1).alias("conv_id"), (F.col("id") % 700).alias("turn"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    crowd = spark.range(600).select(F.lit(2).alias("conv_id"), F.lit(0).alias("turn"), F.lit("a").alias("role"), F.concat(F.lit("u"), "id").alias("text"))
    got = chat.rotate(turns.unionByName(crowd)).collect()
    for conv, want in ((1, 1000), (2, 600)):
        parts = sorted((r for r in got if r.conv_id == conv and r.perspective == "a"), key=lambda r: r.part)
        assert [r.part for r in parts] == list(range(len(parts))) and sum(r.n_turns for r in parts) == want and max(r.n_turns for r in parts) <= chat.CROWDED


@pytest.mark.parametrize("n", [256, 257, 300])
def test_crowded_chats_equal_sql(spark, tmp_path, n):
    """Repeated and null turn numbers and ids, at either side of CROWDED, beside a dialogue that starts at turn 1; very long texts."""
    one = [(1, None if k % 2 else 5, ("a", "b\nc\r<|")[k % 3 == 0], f"t{k}") for k in range(2 * n)] + [(None, 3, "a", "none"), (None, None, "b", "x" * 300_000)]
    turns = spark.createDataFrame([*one, *((2, k, "ab"[k % 2], f"u{k}") for k in range(1, 71))], "conv_id LONG, turn INT, role STRING, text STRING")
    turns = turns.withColumns({c: F.lit("own") for c in ("part", "perspective", "_conv", "_block", "people")})
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    assert_same(QUERIES["op1_chat"](spark, str(tmp_path)), ORACLES["op1_chat"], str(tmp_path))


@pytest.mark.parametrize("n", [256, 257, 600])
def test_bounded_parts_are_neighbouring_turns(spark, n):
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    got = sorted((r for r in chat.rotate(turns).collect() if r.perspective == "a"), key=lambda r: r.part)
    assert [r.n_turns for r in got] == [min(256, n - k) for k in range(0, n, 256)]
    assert "".join(r.text for r in got) == next(r.text for r in chat.rotate(turns, most=None).collect() if r.perspective == "a")


# 2 ---------------------------------------------------------------------------------------------------------------------


def test_patience():
    assert lines.patience([1, 2, 3, 4, 5], [9, 2, 3, 8, 5]) == [(1, 1), (2, 2), (4, 4)]
    assert lines.patience([1, 1, 2, 1], [1, 2, 1, 1]) == [(0, 0), (2, 1), (3, 3)]
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 12, rng.integers(0, 15)).tolist(), rng.integers(0, 12, rng.integers(0, 15)).tolist()
        got = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    assert lines.patience(list(range(9)), list(range(9))) == [(k, k) for k in range(9)]


def test_line_dedup(docs, clashing, empty):
    got = {(r.doc_id, r.n_lines): r for r in lines.remove(docs).collect()}
    assert sum(1 for _ in lines.remove(docs).collect()) == docs.count()
    assert got[17, 3].n_removed == 0 and got[18, 3].n_removed == 2 and got[18, 3].kept == "other beginning of text" and got[18, 3].n_partners == 1
    assert got[8, 1].n_removed == 1 and got[8, 1].kept == "" and got[7, 1].n_removed == 0  # a whole copy
    assert got[0, 0].kept is None and got[1, 1].kept == ""
    assert lines.remove(empty).count() == 0
    own = lines.remove(clashing)
    assert own.count() == docs.count() and own.where("marks <> 'own marks' OR _d <> 'own _d'").count() == 0


def test_line_dedup_of_frequent_lines(spark):
    """A line in many documents and a group of near copies: later ones lose what the earliest has."""
    rows = [(k, f"the same header line for all\nown line number {k} of this text\nbody alpha beta gamma delta {k % 2}") for k in range(60)]
    got = {r.doc_id: r for r in lines.remove(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()}
    assert got[0].n_removed == 0 and got[1].n_removed == 1 and all(got[k].n_removed == 2 for k in range(2, 60))


def brute_lines(rows):
    """Lines left of each document (d, text, in order) after a patience diff with every earlier one."""
    held = [(d, t.split("\n")) for d, t in rows]
    sizes, out = [[len(words(x)) for x in ls] for _, ls in held], {}
    for k, (d, b) in enumerate(held):
        gone = {y for _, a in held[:k] if set(a) & set(b) for y in lines.blocks(lines.patience(a, b), sizes[k], 5)}
        out[d] = (len(gone), "\n".join(x for j, x in enumerate(b) if j not in gone))
    return out


def test_line_dedup_is_that_of_all_pairs(spark):
    """Frequent lines that stand twice in their earliest holder, short lines with different earliest holders, near copies."""
    hot, short = "one line that very many documents have", ["two words", "three more words", "four"]
    rows = [(0, f"{hot}\na\n{hot}\nb"), (1, f"x\n{short[0]}\ny"), (2, f"x2\n{short[1]}\ny2")]
    rows += [(k, f"own text {k}\n{hot}\nmiddle {k}\n" + "\n".join(short[:2]) + f"\nend {k}") for k in range(3, 20)]
    rng = np.random.default_rng(5)
    pool = [hot, *short, "", "", "another frequent line of many words", "a third one with five words", *(f"rare line of five words {k}" for k in range(40))]
    rows += [(k, "\n".join(pool[min(int(rng.exponential(7)), len(pool) - 1)] for _ in range(rng.integers(1, 9)))) for k in range(20, 220)]
    got = {r.doc_id: (r.n_removed, r.kept) for r in lines.remove(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()}
    assert got == brute_lines(rows)
    assert got[4][1] == "own text 4\nmiddle 4\nend 4"


# 3 ---------------------------------------------------------------------------------------------------------------------


def test_exact_dedup(spark, docs, clashing, empty):
    index = exact_dedup.DigestIndex(spark, "index_of_tests", buckets=4)
    got = index.add(docs, "first").collect()
    assert len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    for g in by.values():
        least = min((r.doc_id for r in g if r.doc_id is not None), default=None)
        assert all(r.keep_id == least and r.group_size == len(g) and r.kept == (r.doc_id == least) for r in g)
    again = index.add(spark.createDataFrame([(100, "one  two\nthree"), (101, "new"), (102, "new")], "doc_id LONG, text STRING"), "second").collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in again} == {100: (4, 2, False), 101: (101, 2, True), 102: (101, 2, False)}
    assert index.read().count() == len(by) + 1
    assert exact_dedup.DigestIndex(spark, "index_of_nothing").add(empty, "x").count() == 0
    assert exact_dedup.dedup(clashing).count() == len(by)
    assert exact_dedup.dedup(clashing).columns == clashing.columns and exact_dedup.dedup(empty).count() == 0
    assert index.add(clashing, "third").where("kept").count() == 0


def test_digest_index_is_safe_to_run_again(spark, tmp_path):
    """A batch added twice gives the same result twice; a later session finds the folder; compaction leaves one file per bucket."""
    at = f"file://{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, "index_to_repeat", 4, at)
    one, two = (spark.createDataFrame(r, "doc_id LONG, text STRING") for r in ([(1, "a"), (2, "a "), (3, "b'")], [(4, "a"), (5, "c"), (None, "c"), (6, "")]))
    said = lambda df, batch: sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in index.add(df, batch).collect())
    first = said(one, "it's one")
    assert first == said(one, "it's one") == [("1", 1, 1, True), ("2", 2, 1, True), ("3", 3, 1, True)]
    second = said(two, "two")
    assert second == said(two, "two") == [("4", 1, 2, False), ("5", 5, 2, True), ("6", 6, 1, True), ("None", 5, 2, False)]
    index.drop()
    index.create()
    assert index.read().count() == 5 and said(two, "two") == second
    index.compact("all")
    assert index.read().count() == 5 and {r.batch for r in spark.table(index.name).select("batch").collect()} == {"all"}
    plan = index.read()._jdf.queryExecution().toString()
    assert "Exchange" not in plan, plan
    assert said(one, "three") == [("1", 1, 2, False), ("2", 2, 2, False), ("3", 3, 2, False)]
    with pytest.raises(ValueError):
        index.compact("all")
    index.drop()


# 4 ---------------------------------------------------------------------------------------------------------------------


def test_quality(spark, docs, clashing, empty):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op4_quality"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9, auc
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)] + [(3, None), (None, 1), (4, 7)], "doc_id LONG, quality INT")
    model = quality.train(docs, labels, F.lit(True))
    got = quality.score(clashing, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score(empty, model).count() == 0
    none = quality.train(docs, labels.where("false"), F.lit(True))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.train(empty, labels, F.lit(True)).slope == 0


def brute_indicators(text):
    """Buckets of the words, neighbouring words and runs of three bytes of a text."""
    data, top = (text or "").encode(), (1 << 64) - 1
    h = [xxhash.xxh3_64_intdigest(w.encode()) for w in words(text)]

    def spread(x):
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = ((x ^ x >> 33) * factor) & top
        return x ^ x >> 33

    out = {x & 0xFFFF for x in h} | {0x10000 + (spread((a * 3 + b) & top) & 0xFFFF) for a, b in zip(h, h[1:])}
    return out | {0x20000 + ((int.from_bytes(data[k : k + 3], "big") * 0x9E3779B1 & 0xFFFFFFFF) >> 16) for k in range(len(data) - 2)}


def test_quality_is_brute_force(spark):
    """Ratios of all labelled training rows, and scores of all rows from the weights, by loops over the texts."""
    rows, labels = small_documents(spark), {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    away = lambda i: binascii.crc32(str(i).encode()) % 5 == 0
    usable = ~F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), usable)
    counts = np.ones((2, 3 << 16))
    features = {i: sorted(brute_indicators(t)) for i, t in rows}
    for i, _ in rows:
        if i in labels and not away(i):
            counts[labels[i], features[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    assert np.allclose(ratio, model.ratio)
    got = {r.doc_id: r for r in QUERIES["op4_quality"](spark, SMALL).collect()}
    for i, _ in rows:
        x = ratio[features[i]]
        margin = (x @ model.weight[features[i]]) / max(np.sqrt(x @ x), 1e-12) + model.bias
        assert math.isclose(got[i].score, 1 / (1 + math.exp(-(model.slope * margin + model.shift))), rel_tol=1e-6)
        assert got[i].held_out == away(i) and got[i].predicted == int(got[i].score >= 0.3)


def test_dual_descent_reaches_the_least_loss():
    """The loss is convex, so weights that no small step betters are the best ones."""
    rng = np.random.default_rng(4)
    for c in (0.1, 1.0, 5.0):
        x = rng.normal(size=(40, 6)) * (rng.random((40, 6)) < 0.6)
        y = np.where(x @ rng.normal(size=6) + 0.3 * rng.normal(size=40) > 0.2, 1.0, -1.0)
        rows = [np.flatnonzero(r).astype(np.int32) for r in x]
        w, bias = quality.descend(rows, [r[i] for r, i in zip(x, rows, strict=True)], y, 6, c, 3000, 1)
        loss = lambda w, b: (w @ w + b * b) / 2 + c * np.maximum(0, 1 - y * (x @ w + b)).sum()  # noqa: E731, B023
        best = loss(w, bias)
        for scale in (1e-1, 1e-2, 1e-3):
            steps = rng.normal(size=(300, 7)) * scale
            assert min(loss(w + s[:6], bias + s[6]) for s in steps) > best - 2e-3 * best


# 5 ---------------------------------------------------------------------------------------------------------------------


def test_suffix_arrays():
    """Texts of few words against plain sorting, whole suffixes and their first five words."""
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(0, 60))
        h, cuts = rng.integers(1, 4, n).astype(np.uint64), rng.integers(0, n + 1, 3)
        end = [min((c for c in cuts.tolist() if c > k), default=n) for k in range(n)]
        suffix = lambda k: tuple(h[k : end[k]].tolist())  # noqa: E731, B023
        last = np.array(end, int) - np.arange(n)
        assert decontaminate.suffix_array(h, last).tolist() == sorted(range(n), key=lambda k: (suffix(k), k))
        some = decontaminate.suffix_array(h, last, 5).tolist()
        assert sorted(some) == list(range(n)) and all(suffix(a)[:5] <= suffix(b)[:5] for a, b in zip(some, some[1:]))


def brute_matches(w, items, starts):
    """Longest common runs of words from each start, but those within an earlier one."""
    out, reach = [], -1
    for k in sorted(starts or ()):
        n = 0
        for x in items:
            for j in range(len(x)):
                m = 0
                while k + m < len(w) and j + m < len(x) and w[k + m] == x[j + m]:
                    m += 1
                n = max(n, m)
        if k + n > reach:
            out.append((k, n))
            reach = k + n
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_longest_matches(spark, block_bytes):
    """Matches over 10 words, of items that overlap and that several documents copy, found in one block or many."""
    item = [f"q{k}" for k in range(50)]
    other = [*item[20:35], *(f"z{k}" for k in range(20))]
    bench = spark.createDataFrame([("a", " ".join(item)), ("b", " ".join(other)), ("c", " ".join(item)), ("d", "short one"), (None, "null id")], "item_id STRING, text STRING")
    texts = [["x", *item[5:40], "y"], [*item, *item], [*other[3:18], "mid", *item[:9], "short", "one"], [*item[20:35], "z0", "z1", "null", "id"], ["nothing"], [*item[:9]]]
    docs = spark.createDataFrame([(k, " ".join(t).upper()) for k, t in enumerate(texts)], "doc_id LONG, text STRING")
    got = {r.doc_id: r for r in decontaminate.find(docs, bench, block_bytes=block_bytes).collect()}
    low = [[x.lower() for x in t] for t in texts]
    held = [item, other, ["short", "one"], ["null", "id"]]
    grams = {tuple(w[k : k + 10]) for w in held for k in range(max(1, len(w) - 9))}
    for k, w in enumerate(low):
        starts = {p for g in grams for p in range(len(w) - len(g) + 1) if tuple(w[p : p + len(g)]) == g}
        assert [(m.start, m.length) for m in got[k].matches] == brute_matches(w, held, starts), k
    assert [(m.start, m.length, m.item_start) for m in got[0].matches] == [(1, 35, 5)] and got[0]["items"] == ["a", "b", "c"]
    assert got[3]["items"] == ["a", "b", "c", None] and [m.item for m in got[3].matches] == ["b", None]


@pytest.mark.parametrize("block_bytes", [1 << 20, 80])
def test_decontamination(docs, clashing, empty, benchmark, block_bytes):
    def tokens(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    items = [(r.item_id, tokens(r.text)) for r in benchmark.collect()]
    windows = defaultdict(set)
    for i, w in items:
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    got = decontaminate.find(clashing, benchmark, block_bytes=block_bytes).collect()
    assert len(got) == docs.count()
    for r in got:
        w, hit, found = tokens(r.text), set(), set()
        for s in windows:
            for k in range(len(w) - len(s) + 1):
                if tuple(w[k : k + len(s)]) == s:
                    hit |= set(range(k, k + len(s)))
                    found |= windows[s]
        assert (r.n_words, sum(s.length for s in r.spans), r["items"]) == (len(w), len(hit), sorted(found, key=lambda i: (i is None, i or ""))), r.doc_id
        assert {k for s in r.spans for k in range(s.start, s.start + s.length)} == hit
        assert [(m.start, m.length) for m in r.matches] == brute_matches(w, [x for _, x in items], hit and {k for s in windows for k in range(len(w) - len(s) + 1) if tuple(w[k : k + len(s)]) == s})
        for m in r.matches:
            assert any(i == m.item and x[m.item_start : m.item_start + m.length] == w[m.start : m.start + m.length] for i, x in items)
    assert decontaminate.find(empty, benchmark).count() == 0
    assert decontaminate.find(docs, benchmark.where("false")).where("size(spans) > 0").count() == 0
    assert decontaminate.decontaminate(docs, benchmark, block_bytes=block_bytes).count() == sum(not r.spans for r in got)


# 6 ---------------------------------------------------------------------------------------------------------------------


def test_archive(spark):
    big, other = "x" * 2000, "é" * 600
    rows = [(1, "http://a", big), (5, "http://b", big), (3, None, big), (4, "http://c\r\nX: y", "small"), (9, "http://d", "small"), (10, "u", None), (11, "u", ""), (None, "u", big), (None, "u", other), (5, "http://b", big), (6, "u", other)]
    pages = spark.createDataFrame([(*r, "mine") for r in rows], "page_id LONG, url STRING, html STRING, digest STRING")
    archive = warc.Archive(spark, scratch(spark, "t"))
    archive.write(pages)
    got = archive.read().collect()
    assert len(got) == len(rows)
    kinds = Counter((r.page_id, r.record_type, r.refers_to, bytes(r.payload)) for r in got)
    b, o = big.encode(), other.encode()
    assert kinds == Counter([(1, "revisit", 5, b), (5, "response", None, b), (5, "response", None, b), (3, "revisit", 5, b), (4, "response", None, b"small"), (9, "response", None, b"small"), (10, "response", None, b""), (11, "response", None, b""), (None, "revisit", 5, b), (None, "revisit", 6, o), (6, "response", None, o)])
    assert all(r.sha1 == hashlib.sha1(bytes(r.payload)).hexdigest() for r in got)
    assert archive.payloads().count() == 4
    for r in archive.records().collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert rest == rest[: int(re.search(rb"Content-Length: (\d+)", head)[1])] + b"\r\n\r\n"
    assert all(bytes(r.record) == bytes(r.header) + (b"" if r.record_type == "revisit" else bytes(r.payload)) + b"\r\n\r\n" for r in got)
    archive.export(path := scratch(spark, "export"))
    assert spark.read.text(path, wholetext=True).selectExpr("sum(size(split(value, 'WARC/1.1\\r\\n')) - 1) AS n").first().n == len(rows)
    hot = spark.range(3500).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit(big).alias("html"))
    archive = warc.Archive(spark, scratch(spark, "t"))
    archive.write(hot)
    assert archive.read().groupBy("record_type").count().collect() and archive.read().where("refers_to = 3499").count() == 3499 and archive.payloads().first().parts == 4
    archive = warc.Archive(spark, scratch(spark, "t"))
    archive.write(pages.where("false"))
    assert archive.read().count() == 0


def test_archive_of_foreign_records(spark):
    """Exact headers and bytes that are not UTF-8 come back as they were; very long, empty, null and equal records."""
    head = lambda n, more=b"": b"WARC/1.0\r\nWARC-Type: resource\r\nX-Odd:  \xff\xfe two  spaces\r\n" + more + b"Content-Length: " + str(n).encode() + b"\r\n\r\n"
    bodies = [b"\x00\xff\xfe", b"a" * 3_000_000, b"", b"same", b"same", "é".encode()]
    rows = [(bytearray(head(len(b), b"A: %d\r\n" % k)), bytearray(b), "mine") for k, b in enumerate(bodies)] + [(bytearray(head(4)), bytearray(b"same"), "mine")] * 2 + [(bytearray(b"WARC/1.0\r\n\r\n"), None, "mine"), (None, None, "mine")]
    records = spark.createDataFrame(rows, "header BINARY, payload BINARY, digest STRING")
    archive = warc.Archive(spark, scratch(spark, "t"))
    archive.put(records)
    want = Counter(bytes(h or b"") + bytes(b or b"") + b"\r\n\r\n" for h, b, _ in rows)
    assert Counter(bytes(r.record) for r in archive.records().collect()) == want and archive.payloads().count() == len({bytes(b or b"") for _, b, _ in rows})
    with pytest.raises(Exception, match="(?i)utf"):
        archive.export(scratch(spark, "export"))
    archive = warc.Archive(spark, scratch(spark, "t"))
    archive.put(spark.createDataFrame([(bytearray(head(5)), bytearray(b"four"))], "header BINARY, payload BINARY"))
    with pytest.raises(Exception, match="not as declared"):
        archive.records().collect()


def test_damaged_payloads_are_seen(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 2_000_000), (2, "v", "y")], "page_id LONG, url STRING, html STRING")
    archive = warc.Archive(spark, scratch(spark, "t"))
    archive.write(pages)
    assert archive.read().agg(F.sum(F.octet_length("payload"))).first()[0] == 2_000_001
    held = archive.payloads().withColumn("payload", F.when(F.octet_length("payload") == 1, F.lit(b"z")).otherwise(F.col("payload")))
    other = warc.Archive(spark, scratch(spark, "t"))
    held.write.parquet(f"{other.path}/payloads")
    spark.read.parquet(f"{archive.path}/headers").write.parquet(f"{other.path}/headers")
    with pytest.raises(Exception, match="damaged payload"):
        other.records().collect()


# 7 ---------------------------------------------------------------------------------------------------------------------


def test_mixing(spark, docs, clashing, empty):
    got = mixing.mix(clashing).collect()
    assert len(got) == docs.count() and all(r.taken <= 3 * r["size"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    assert math.isclose(sum(g[0].target for g in by.values()), sum(r["size"] for r in got))
    assert all(g[0].target <= 3 * g[0].source_size + 1e-6 and g[0].source_size == sum(r["size"] for r in g) for g in by.values())
    key = lambda r: (str(r.doc_id), str(r.text)[:50], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(empty).count() == 0
    assert all(r.times <= 3 for r in got)
    d = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    worst = d.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m")).collect()
    assert all(abs(r.t - r.g) <= r.m for r in worst)


def test_water_filling(spark):
    def brute(sizes, weights, cap):
        left, free, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
        while free:
            total = sum(weights[i] for i in free)
            over = [i for i in free if left * weights[i] / total > cap * sizes[i] + 1e-9]
            if not over:
                for i in free:
                    out[i] = left * weights[i] / total
                break
            for i in over:
                out[i] = cap * sizes[i]
            free -= set(over)
            left = sum(sizes) - sum(out)
        return out

    rng = np.random.default_rng(3)
    for _ in range(6):
        sizes = rng.integers(0, 1000, 6).tolist()
        weights = [5, 2, 1, 5, 2, 1]
        df = spark.createDataFrame([(k, w, s, k) for k, (w, s) in enumerate(zip(weights, sizes))], "source INT, weight INT, size LONG, _rank INT")
        got = {r.source: r.target for r in mixing.water_fill(df, F.lit(float(sum(sizes))), 3.0).collect()}
        assert np.allclose([got[k] for k in range(6)], brute(sizes, weights, 3.0)), sizes


# 8 ---------------------------------------------------------------------------------------------------------------------


def brute_substrings(rows, window):
    c, held = Counter(), []
    for i, t in rows:
        w = words(t)
        held.append((i, w))
        c.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    out = []
    for i, w in held:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if c[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return Counter(out)


@pytest.mark.parametrize("tree_rows", [512, 6, 1])
def test_substring_dedup(spark, docs, clashing, empty, tree_rows, monkeypatch):
    monkeypatch.setattr(substring, "TREE_ROWS", tree_rows)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove(clashing).collect())
    assert got == brute_substrings(rows, 35)
    assert substring.remove(empty).count() == 0
    rng = np.random.default_rng(5)  # few words, so that windows repeat in many ways
    texts = [(k, " ".join(rng.choice(["a", "b"], rng.integers(5, 60)).tolist())) for k in range(80)]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove(spark.createDataFrame(texts, "doc_id LONG, text STRING"), window=11).collect())
    assert got == brute_substrings(texts, 11)


def thue_morse(n):
    """Two different words of 2^n letters that polynomial hashes with an odd base modulo 2^64 cannot tell apart from n = 10 on."""
    w = "a"
    for _ in range(n):
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_words_that_simple_hashes_confuse(spark):
    a, b = thue_morse(12)
    shared = " ".join(f"w{k}" for k in range(40))
    rows = [(0, f"{a} {shared}"), (1, f"{b} {shared}"), (2, f"{a} x y"), (3, f"{b} x z")]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove(df).collect())
    assert got == brute_substrings(rows, 35) and {r[2] for r in got} == {40, 0}
    bench = spark.createDataFrame([("i", f"{a} w0")], "item_id STRING, text STRING")
    assert {r.doc_id: len(r.spans) for r in decontaminate.find(df, bench).collect()} == {0: 1, 1: 0, 2: 0, 3: 0}
    known = {r.doc_id: r.n_known for r in ctw.score(df, F.col("doc_id") == 2).collect()}
    assert known == {0: 2, 1: 1, 2: 4, 3: 2}
    h = quality.Words(*texts_of(pa.array([f"{a} {b}"]))).hashes()
    assert h[0] != h[1]


def test_substring_query(spark):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op8_substring_dedup"](spark, SMALL).collect())
    assert got == Counter((i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in brute_substrings(small_documents(spark), 35))


# 9 ---------------------------------------------------------------------------------------------------------------------


def brute_simhash(rows):
    prints = []
    for i, t in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                parent[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        r = top(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return Counter((i, f"{f:016x}", least[top(k)]) for k, (i, f) in enumerate(prints))


def test_simhash(spark, docs, clashing, empty):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op9_simhash"](spark, SMALL).collect())
    assert got == brute_simhash(small_documents(spark))
    rows = [(r.doc_id, r.text) for r in docs.collect() if not (r.doc_id in (3, 4) or r.doc_id is None)]
    some = docs.where("doc_id NOT IN (3, 4)")
    assert Counter((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_groups(some).collect()) == brute_simhash(rows)
    assert simhash.near_groups(clashing).count() == docs.count() and simhash.near_groups(empty).count() == 0


def test_simhash_of_null_and_repeated_ids(spark, docs):
    """Rows without an id, or with one id, are tied by their texts alone, and the pipeline's stage keeps one row of each component."""
    texts = ["all about rivers and lakes in the north", "how to bake bread with rye and seeds", "chess openings that masters play today", "rows of numbers in a ledger of accounts"]
    rows = [(None, texts[0]), (1, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (7, texts[3]), (7, "another text of the same identity number")]
    some = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    for df, held in ((some, rows), (docs, [(r.doc_id, r.text) for r in docs.collect()])):
        got = [(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_groups(df).collect()]
        assert Counter(got) == brute_simhash(held)
    assert Counter((r.doc_id, r.text) for r in simhash.dedup(some).collect()) == Counter([(1, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, rows[-1][1])])


@pytest.mark.parametrize("most", [64, 2])
def test_links_in_large_blocks(spark, most, monkeypatch):
    """Chains of close fingerprints, by pairs and by way of neighbours."""
    monkeypatch.setattr(simhash, "PAIRS", most)
    rng = np.random.default_rng(7)
    fps = {0}
    while len(fps) < 200:
        f = int(rng.choice(sorted(fps))) & (1 << 64) - 1
        for b in rng.integers(0, 64, rng.integers(1, 4)):
            f ^= 1 << int(b)
        fps.add(f - (1 << 64) if f >> 63 else f)
    fps = sorted(fps)
    got = {r.node: r.component for r in simhash.components(simhash.links(spark.createDataFrame(list(zip(fps, range(len(fps)))), "fp LONG, rep LONG"))).collect()}
    parent = list(range(len(fps)))
    for _ in fps:
        for a in range(len(fps)):
            for b in range(a):
                if ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= 2:
                    parent[a] = parent[b] = min(parent[a], parent[b])
    assert [got.get(k, k) for k in range(len(fps))] == parent


# 10 --------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("head", [ctw.HEAD_ROWS, 50])
def test_language_model(docs, clashing, empty, head, monkeypatch):
    monkeypatch.setattr(ctw.split, "__defaults__", (head,))
    train = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    got = ctw.score(clashing, train).collect()
    assert len(got) == docs.count()
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = lambda t: [*words(low(t)), None]
    c = Counter(x for r in docs.collect() if r.doc_id is not None and r.doc_id % 2 == 0 for x in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = Counter((r.doc_id, len(tokens(r.text)), sum(c[x] > 0 for x in tokens(r.text)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(r.text)), 4)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got) and all(r["key"] == "own key" for r in got)
    assert ctw.score(empty, train).count() == 0
    none = ctw.score(docs, F.lit(False)).where("doc_id = 6").first()
    assert math.isclose(none.score, -8 * len("one two three\n") * math.log10(2), rel_tol=1e-9) and none.train_tokens == 0


def brute_ctw(texts, learned):
    """log10 probability of each text: every decision walks its contexts from the root, nodes weighed as in context-tree weighting."""
    d, stream = ctw.DEPTH, lambda t: b"\n" * ctw.DEPTH + b" ".join("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split(None)) + b"\n"
    decisions = lambda t: [(stream(t)[k - d : k], f"{stream(t)[k]:08b}"[:j], int(f"{stream(t)[k]:08b}"[j])) for k in range(d, len(stream(t))) for j in range(8)]
    counts = defaultdict(lambda: [0, 0])
    for t in learned:
        for ctx, prefix, bit in decisions(t):
            for k in range(d + 1):
                counts[ctx[d - k :], prefix][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    children = defaultdict(list)
    for ctx, prefix in counts:
        if ctx:
            children[ctx[1:], prefix].append((ctx, prefix))
    weighted, own = {}, {}
    for node in sorted(counts, key=lambda x: -len(x[0])):
        mine = kt(*counts[node])
        weighted[node] = mine if len(node[0]) == d else np.logaddexp(mine, sum(weighted[c] for c in children[node])) - math.log(2)
        own[node] = 1.0 if len(node[0]) == d else math.exp(mine - math.log(2) - weighted[node])
    out = []
    for t in texts:
        score = 0.0
        for ctx, prefix, bit in decisions(t):
            p, total, left = 0.5, 0.0, 1.0
            for k in range(d + 1):
                node = ctx[d - k :], prefix
                if node not in counts:
                    break
                a, b = counts[node]
                e = (b + 0.5) / (a + b + 1)
                p, total, left = total + left * e, total + left * own[node] * e, left * (1 - own[node])
            score += math.log10(p if bit else 1 - p)
        out.append(score)
    return out


@pytest.mark.parametrize("head", [ctw.HEAD_ROWS, 20])
def test_scores_are_those_of_the_trees(spark, head, monkeypatch):
    """Whole texts, training and held out, through every piece of the trees and both ways of looking up."""
    monkeypatch.setattr(ctw.split, "__defaults__", (head,))
    texts = ["the cat sat on the mat", "The cat  ate\tthe rat", "a dog sat on the log", None, "", "Ünï thé cat", "the the the the the the", "zebra quilts", "the mat sat on the cat", "other ends and other means"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    got = {r.doc_id: r.score for r in ctw.score(df, F.col("doc_id") < 7).collect()}
    assert np.allclose([got[k] for k in range(len(texts))], brute_ctw(texts, texts[:7]), rtol=1e-9)


def test_context_trees_are_a_distribution():
    """Probabilities of all bytes after any context sum to one, and match a direct context-tree mixture."""
    rng = np.random.default_rng(2)
    text = rng.integers(97, 101, 400).astype(np.uint64)
    d = ctw.DEPTH
    runs = np.zeros(len(text) - d, np.uint64)
    for k in range(d + 1):
        runs = (runs << np.uint64(8)) | text[k : k + len(runs)]
    keys, n = np.unique(runs, return_counts=True)
    trees = ctw.levels(keys, n, 0)
    context = keys[7] & ~np.uint64(255)
    every = np.unique(np.concatenate([keys, context | np.arange(256, dtype=np.uint64)]))
    count = np.zeros(len(every), np.int64)
    count[np.searchsorted(every, keys)] = n
    p = 10 ** ctw.log10_run(context | np.arange(256, dtype=np.uint64), ctw.levels(every, count, 0))
    assert math.isclose(p.sum(), 1.0, rel_tol=1e-9)

    def weighted(depth, ctx, prefix):
        """log probability of the decisions after `prefix` in contexts that end with ctx."""
        own = [(k, m) for k, m in zip(keys.tolist(), n.tolist()) if (k >> 8) & ((1 << 8 * depth) - 1) == ctx and (k & 255 | 256) >> (8 - (prefix.bit_length() - 1)) == prefix]
        bit = lambda k: (k & 255) >> (7 - (prefix.bit_length() - 1)) & 1
        a, b = sum(m for k, m in own if not bit(k)), sum(m for k, m in own if bit(k))
        kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
        if depth == d:
            return kt
        below = sum(weighted(depth + 1, (x << 8 * depth) | ctx, prefix) for x in {k >> 8 * (depth + 1) & 255 for k, _ in own})
        return np.logaddexp(kt, below) - math.log(2)

    root = trees[0]
    assert math.isclose(root.log_weighted[np.searchsorted(root.keys, np.uint64(1))], weighted(0, 0, 1), rel_tol=1e-9)


def test_training_rows_of_the_query(spark):
    got = QUERIES["op10_ctw"](spark, SMALL).collect()
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)

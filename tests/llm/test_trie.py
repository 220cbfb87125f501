"""The trie of conversations against SQL and a brute-force version."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from util import assert_same

from barloom.llm import sequences, trie
from barloom.llm.queries import OP12_SQL, QUERIES

KIND = "conv_id LONG, turn LONG, role STRING, text STRING"


def brute(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    held = {}
    for c, said in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        held[c] = own.get(base, [])[:h] + said[h:]
    members = defaultdict(list)
    for c, said in held.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    kids = defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, of in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(of) - 1) * len(k[-1][1] if k else "")
    return sorted(
        (min(of), len(k), min(members[k[:-1]]) if k else -1, len(of), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(str(c) for c in sorted(of) if len(held[c]) == len(k)).encode()).hexdigest())
        for k, of in list(members.items())
    )


def got(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def test_query_equals_sql(spark):
    assert assert_same(QUERIES["op12_prefix_trie"](spark, "/root/testdata/sf0.001"), OP12_SQL, "/root/testdata/sf0.001") > 0


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    """Copies, shared starts, ties, nulls, repeated rows, negative and absent first conversations, one conversation of 300 turns."""
    monkeypatch.setattr(sequences, "CHUNK_PIECES", 3)
    dice = random.Random(seed)
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 99, 100, 101, 102, 103, 205, 206, 207, 208, 209, -5, -100, -101, None]
    rows = [(c, dice.choice([None, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9]), dice.choice(["user", "assistant", None, ""]), dice.choice(["a", "b", "é😀", None, ""])) for c in ids for _ in range(dice.choice([1, 1, 3, 8, 12]))]
    start = [(k, "user", f"turn {k}") for k in range(9)]
    rows += [(c, *t) for c in range(400, 440) for t in start[: dice.randint(1, 9)]] + [(777, k // 2, "user", "same") for k in range(300)] + rows[:20]
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("own") for c in ("pos", "name", "n", "base", "depth", "length", "_at", "_salt")}).repartition(5)
    assert got(trie.shared_prefixes(df)) == brute(rows)


def test_one_and_none(spark):
    one = spark.createDataFrame([(700, None, None, None)], KIND)
    assert got(trie.shared_prefixes(one)) == brute([(700, None, None, None)])
    assert trie.shared_prefixes(one.where("false")).count() == 0
    # A conversation without turns: its first is absent, and it has fewer of its own than it would take.
    few = [(c, 0, "user", "hi") for c in range(801, 812)]
    assert got(trie.shared_prefixes(spark.createDataFrame(few, KIND))) == brute(few)


def test_digests_of_joined_pieces(spark, monkeypatch):
    monkeypatch.setattr(sequences, "CHUNK_PIECES", 7)
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.lit("x").alias("j"), F.col("id").alias("at"), F.concat(F.lit("é"), "id").alias("p"))
    want = {k: hashlib.sha256("\n".join(f"é{i}" for i in range(k, 500, 3)).encode()).hexdigest() for k in range(3)}
    assert {r.k: r.sha256 for r in sequences.joined_sha256(df.repartition(6), ["k", "j"], ["at"], "p", "\n").collect()} == want

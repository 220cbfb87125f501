"""Packing against the tokenizer itself, one text at a time."""

import random
import zlib
from collections import defaultdict
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm_operators import SMALL
from tokenizers import Tokenizer

from barloom.llm import packing
from barloom.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def strange(n):
    """Texts of words, marks, white space of all kinds, contractions, added tokens, combining marks."""
    dice = random.Random(5)
    parts = ["word", "Ünï", "çé", "it's", "'", "  ", " ", "\n", "\r\n", "\t", " ", "　", " ", "\u0085", "…", "×", "÷", ",", ".", "?!", "é", "12", "٣", "<|endoftext|>", "|", "中文", "😀", "\x1c", "\x00", "_", "-", " ", "´", "Ā", "”", ")", "(", ":"]
    return ["".join(dice.choices(parts, k=dice.randint(0, 12))) for _ in range(n)]


def check(rows, texts, tokenizer, most=1024):
    """rows of pieces; texts: (doc_id, text), each doc_id once."""
    of = defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
    assert set(of) == {i for i, _ in texts} and len({r.sequence_id for r in rows}) == len(rows)
    for i, text in texts:
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(of[i], key=lambda r: r.start)
        assert [x for r in own for x in np.frombuffer(r.ids, "<u4").tolist()] == want, text
        sizes = [r.length for r in own]
        assert sizes == [most] * (len(want) // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if len(want) % most >> b & 1]
        assert [r.start for r in own] == [0, *accumulate(sizes)][:-1] and all(r.offset == 0 and r.doc_tokens == len(want) and 1 << r.bucket == r.length for r in own)


@pytest.mark.parametrize("remembered", [1 << 19, 50])
def test_ids_of_strange_texts(tokenizer, remembered, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", remembered)
    tokens, texts = packing.Tokens(PATH), strange(3000)
    for lo in range(0, len(texts), 40):
        held = [t.encode() for t in texts[lo : lo + 40]]
        ids, counts = tokens.ids(np.frombuffer(b"".join(held), np.uint8), np.append(0, np.cumsum([len(t) for t in held])), 0)
        at = np.append(0, np.cumsum(counts))
        for k, t in enumerate(texts[lo : lo + 40]):
            assert ids[at[k] : at[k + 1]].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 0], repr(t)


def test_query_is_the_tokenizers(spark, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in docs}
    assert len(texts) == len(docs)
    total = defaultdict(int)
    for r in QUERIES["op13_packing"](spark, SMALL).collect():
        ids = texts[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        total[r.doc_id] += r.length
    assert {i: len(ids) for i, ids in texts.items()} == total


@pytest.mark.parametrize("most", [1024, 8, 1])
def test_edge_cases(spark, tokenizer, docs, clashing, most):
    once = docs.dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL").withColumns({"ids": F.lit("own"), "start": F.lit("own"), "extra": F.lit("own")})
    got = packing.pack(once, PATH, most)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "extra", *packing.NEW.names] and {r.extra for r in got.collect()} == {"own"}
    check(got.collect(), [(r.doc_id, r.text) for r in once.collect()], tokenizer, most)
    assert packing.pack(docs, PATH, most).agg(F.sum("length")).first()[0] == sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert packing.pack(clashing, PATH, most).count() == packing.pack(docs, PATH, most).count()


def test_empty_and_wrong(spark, empty):
    assert packing.pack(empty, PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty, PATH, 1000)


def test_buckets_as_files(spark, docs, tmp_path):
    packing.write(packing.pack(docs, PATH), str(tmp_path / "packed"))
    for folder in (tmp_path / "packed").glob("bucket=*"):
        assert {r.length for r in spark.read.parquet(str(folder)).collect()} == {1 << int(folder.name.split("=")[1])}

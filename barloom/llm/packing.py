"""Packing of documents into training sequences by the powers of two in their numbers of tokens.

A document of n tokens is n // most pieces of `most` tokens and then a piece for each bit of the rest, longest first. A
piece is a sequence of its own, so no sequence crosses documents, none is padded, and a bucket (a power of two) holds
sequences of one length: a training step takes a batch from one bucket. One pass without a shuffle; tasks know nothing of
each other, whatever a source or a document weighs.

Null and empty texts are the end token alone. A very long text is tokenised in chunks and leaves its task in pieces.
Repeated rows, equal and null doc_ids are documents like any other. Columns of docs with the names of new ones are
replaced. Empty tables give empty ones.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType

from barloom.llm.common import SPACE, map_in_arrow, slices, texts_of

#: Most chunks of text whose ids a Python worker remembers, and pieces in a batch that leaves it.
REMEMBERED, PIECES = 1 << 19, 4096
NEW = StructType().add("start", LongType()).add("length", LongType()).add("doc_tokens", LongType()).add("bucket", IntegerType()).add("ids", BinaryType()).add("sequence_id", LongType()).add("offset", LongType())

PLAIN = np.zeros(256, bool)
PLAIN[0x30:0x3A] = PLAIN[0x41:0x5B] = PLAIN[0x61:0x7B] = True
#: Marks before which texts are cut; no apostrophe, and none that added tokens of vocabularies have inside.
MARK = np.zeros(256, bool)
MARK[list(b",.;:!?)")] = True
#: Control characters that some tables of character classes count as white space.
ODD = np.zeros(256, bool)
ODD[0x1C:0x20] = True


def edges(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte places at which byte-level BPE tokens never span, with those of each text's start; and where a letter or digit ends.

    The tokenizer splits texts by a pattern before it merges bytes. No match of it goes on from something else to white
    space, nor from a letter or digit to one of MARK. Beyond ASCII only the letters of Latin-1 count as
    letters, and whatever might be white space isn't cut behind: fewer cuts give the same ids.
    """
    n = len(data)
    one, two = np.zeros(n + 2, np.uint8), np.zeros(n + 2, np.uint8)
    one[1:-1], two[2:] = data, data
    one, two = one[:n], two[:n]  # the byte before, and the one before that
    letter = PLAIN[data] | ((one == 0xC3) & (data >= 0x80) & (data != 0x97) & (data != 0xB7))
    wide = (data >= 0x80) & (((one == 0xC2) & ((data == 0x85) | (data == 0xA0))) | ((two == 0xE1) & (one == 0x9A)) | ((two == 0xE2) & ((one == 0x80) | (one == 0x81))) | ((two == 0xE3) & (one == 0x80)))
    cut = np.zeros(n + 1, bool)
    cut[1:n] = (SPACE[data[1:]] & ~(SPACE | ODD)[data[:-1]] & ~wide[:-1]) | (MARK[data[1:]] & letter[:-1])
    cut[at] = True
    return np.flatnonzero(cut), letter


class Tokens:
    """Ids of texts by a tokenizer file; each chunk of text is tokenised once while it is remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A token of a byte-level vocabulary has a character for each byte.
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(names.values()) + 1, np.int64)
        for name, k in names.items():
            self.bytes[k] = len(name)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.size = np.zeros(1 << 16, np.uint32), 0
        self.first, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _learn(self, chunks: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        while self.size + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        k, n = len(self.known), len(chunks)
        while k + n > len(self.first):
            self.first, self.count = np.append(self.first, np.zeros_like(self.first)), np.append(self.count, np.zeros_like(self.count))
        self.flat[self.size : self.size + len(ids)] = ids
        self.first[k : k + n] = self.size + np.cumsum(counts) - counts
        self.count[k : k + n] = counts
        self.known.update(zip(chunks, range(k, k + n)))
        self.size += len(ids)

    def _encode(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def chunk_ids(self, chunks: list[bytes], joinable: np.ndarray) -> np.ndarray:
        """Numbers of chunks (under which flat, first and count have their ids). joinable: those that begin with white space and end in a letter or digit."""
        if len(self.known) + len(chunks) > REMEMBERED:
            self.forget()
        new = [k for k, c in enumerate(chunks) if c not in self.known]
        together = [chunks[k] for k in new if joinable[k]]
        for lo in range(0, len(together), 20_000):
            some = together[lo : lo + 20_000]
            ids = np.array([i for e in self._encode([b"".join(some[k : k + 200]) for k in range(0, len(some), 200)]) for i in e], np.uint32)
            ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(c) for c in some])) + 1
            self._learn(some, ids, np.diff(ends, prepend=0))
        alone = [chunks[k] for k in new if not joinable[k]]
        if alone:
            each = self._encode(alone)
            self._learn(alone, np.array([i for e in each for i in e], np.uint32), np.array([len(e) for e in each], np.int64))
        return np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))

    def ids(self, data: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts, `end` after each text's, and how many each text has."""
        rows = len(at) - 1
        cut, letter = edges(data, at)
        if len(cut) < 2:
            return np.full(rows, end, np.uint32), np.ones(rows, np.int64)
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        which = chunks.indices.to_numpy()
        seen = np.zeros(len(chunks.dictionary), np.int64)
        seen[which] = np.arange(len(which))
        number = self.chunk_ids(chunks.dictionary.to_pylist(), SPACE[data[cut[seen]]] & letter[cut[seen + 1] - 1])[which]
        first, count = self.first[number], self.count[number]
        total = np.cumsum(count)
        # A text's chunks end where its bytes end; equal places are empty texts.
        done = np.append(0, total)[np.searchsorted(cut, at)]
        own = np.diff(done)
        out = np.full(int(total[-1]) + rows, end, np.uint32)
        out[np.arange(int(total[-1])) + np.repeat(np.arange(rows), own)] = self.flat[np.arange(int(total[-1])) + np.repeat(first - (total - count), count)]
        return out, own + 1


def pieces(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start in it and length of each piece, in order, of texts of so many tokens."""
    full = counts // most
    row, length = [np.repeat(np.arange(len(counts)), full)], [np.full(int(full.sum()), most)]
    for bit in range(most.bit_length() - 2, -1, -1):
        has = np.flatnonzero(counts % most >> bit & 1)
        row.append(has)
        length.append(np.full(len(has), 1 << bit))
    row, length = np.concatenate(row), np.concatenate(length)
    order = np.argsort(row, kind="stable")
    row, length = row[order], length[order]
    ends = np.cumsum(length)
    return row, ends - length - (np.cumsum(counts) - counts)[row], length


_tokens: dict[str, Tokens] = {}


def pack(docs: DataFrame, tokenizer: str, most: int = 1024, end: int = 0, text: str = "text") -> DataFrame:
    """A row for each piece: the columns of docs but text, then

    start (tokens of its document before it), length (a power of two), doc_tokens (with the end token), bucket (log2 of the
    length), ids (binary, little-endian unsigned 32 bits each), sequence_id (unique; as rerun on the same files and splits),
    offset (0: a sequence is one piece).

    tokenizer: path of a byte-level BPE file of the tokenizers library, the same on all machines. most: a power of two.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")
    kept = [c for c in docs.columns if c not in {text, *NEW.names}]
    schema = StructType([docs.schema[c] for c in kept] + NEW.fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if tokenizer not in _tokens:
            _tokens[tokenizer] = Tokens(tokenizer)
        tokens, made = _tokens[tokenizer], TaskContext.get().partitionId() << 33
        for batch in slices(batches, text):
            ids, counts = tokens.ids(*texts_of(batch[text]), end)
            row, start, length = pieces(counts, most)
            places = np.append(0, np.cumsum(length)) * 4
            for lo in range(0, len(row), PIECES):
                hi = min(lo + PIECES, len(row))
                n, own = hi - lo, ids[places[lo] // 4 : places[hi] // 4].astype("<u4")
                held = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((places[lo : hi + 1] - places[lo]).astype(np.int32)), pa.py_buffer(own)])
                of = pa.array(row[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [batch[c].take(of) for c in kept]
                    + [pa.array(start[lo:hi]), pa.array(length[lo:hi]), pa.array(counts[row[lo:hi]]), pa.array(np.log2(length[lo:hi]).astype(np.int32)), held, pa.array(made + np.arange(n)), pa.array(np.zeros(n, np.int64))],
                    schema.names,
                )
                made += n

    return map_in_arrow(docs.select(*kept, text), work, schema)


def write(packed: DataFrame, path: str) -> None:
    """Sequences as Parquet, a folder for each bucket, so that a reader of one folder has batches of equal length."""
    packed.write.partitionBy("bucket").parquet(path)

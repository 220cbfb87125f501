"""SimHash near-dedup: fingerprints, pigeonhole blocks, Hamming verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import cut, discard, lookup, map_in_arrow, slices, texts_of, with_group

#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Fingerprints in a block up to which all pairs in it are compared; larger blocks go by way of neighbours.
PAIRS = 64


def fingerprint(text: bytes, width: int, seed: int) -> int:
    """64 majority bits over the XXH64 of all shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    ones, n = np.zeros(64, np.int64), max(1, len(words) - width + 1)
    for lo in range(0, n, CHUNK):
        part = words[lo : lo + CHUNK + width - 1]
        if len(words) < width:
            hashes = digest(b" ".join(words), seed)
        else:
            hashes = b"".join([digest(b" ".join(x), seed) for x in zip(*(part[k:] for k in range(width)), strict=False)])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, hash (of the text) and fp (the fingerprint as a signed long) of each row; null text counts as empty."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("fp", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, at = texts_of(batch["text"])
            held, at = data.tobytes(), at.tolist()
            fps = [fingerprint(held[a:b], width, seed) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["hash"], pa.array(fps, pa.int64())], schema.names)

    return map_in_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text")), work, schema)


def block_keys(fp: Column, distance: int) -> Column:
    """Keys of which two fingerprints within the distance share one at least.

    The 64 bits are cut in distance + 2 blocks: at least two blocks of a close pair are equal, so each pair of blocks,
    with their numbers, is a key.
    """
    n = distance + 2
    edges = [64 * k // n for k in range(n + 1)]
    blocks = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    return F.array(*(F.xxhash64(F.lit(k), blocks[i], blocks[j]) for k, (i, j) in enumerate(combinations(range(n), 2))))


def links(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (a > b of rep) that join all nodes (fp, rep; each fp once) whose fingerprints differ in <= distance bits.

    Blocks with up to PAIRS nodes are joined with themselves and each pair verified. In larger blocks each fingerprint
    names its neighbours within half the distance; two close ones share such a neighbour, and those that share one are
    all tied to the least of them. So a block of any size gives a number of rows that grows with its nodes, not pairs.
    """
    if distance != 2:
        raise ValueError("large blocks are worked out for a distance of 2")
    keyed = nodes.select("fp", "rep", F.explode(block_keys(F.col("fp"), distance)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = cut(keyed.join(sizes, "key"), "blocks")
    small = blocks.where(F.col("n") <= PAIRS)
    a, b = small.select("key", "fp", "rep").alias("a"), small.select("key", "fp", "rep").alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") > F.col("b.rep")) & near).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
    crowd = blocks.where(F.col("n") > PAIRS).select("fp", "rep").distinct()
    around = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64)))
    named = crowd.select("rep", F.explode(around).alias("key"))
    least = named.groupBy("key").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    tied = named.join(least, "key").where("rep > b").select(F.col("rep").alias("a"), "b")
    return pairs.unionByName(tied).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node it is connected with) of every node that has an edge (a, b).

    Alternates large-star and small-star steps until nothing changes, about log(n) times; each step's edges are
    written to the shared folder, and the last step's deleted.
    """
    now, mark = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # A hub may have very many neighbours.
        large = lookup(now.select(F.col("a").alias("v"), F.col("b").alias("a")), "a", "v", least).select(F.col("v").alias("a"), F.col("m").alias("b"))
        # In a star around b, a > b goes to b's least neighbour; small star: all not above a node go to the least.
        large = large.where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = lookup(large, "a", "b", least).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = cut(small.select("e.a", "e.b").where("a > b").distinct(), "edges")
        seen = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if seen == mark or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select("b", "b").distinct().toDF("node", "component"))
        mark = seen


def _grouped(docs: DataFrame, text: str, doc_id: str, width: int, seed: int, distance: int) -> DataFrame:
    """doc_id, hash, fp, group (the least fingerprint reachable by links) and component_id of each row."""
    rows = cut(fingerprints(docs, text, doc_id, width, seed).withColumn("_row", F.monotonically_increasing_id()), "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    joined = components(links(nodes.select("fp", F.col("fp").alias("rep")), distance))
    owned = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    owned = with_group(owned, "group", "fp", {"component_id": (F.min("least"), F.min("component_id"))}).drop("least")
    return lookup(rows, "fp", "_row", owned).drop("_row")


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, seed: int = 42, distance: int = 2) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable by links of fingerprints) of each row.

    Null and empty texts have fingerprint 0 and link like any other. Equal fingerprints are one node from the start,
    however many rows have them; nothing else ties rows, so those that repeat a doc_id, or have none, stay apart. The
    component_id is null if no row of the component has a doc_id.
    """
    return _grouped(docs, text, doc_id, width, seed, distance).select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, seed: int = 42, distance: int = 2) -> DataFrame:
    """The rows of docs that stay: of each component one with the smallest doc_id (a null one comes last)."""
    groups = _grouped(docs, text, doc_id, width, seed, distance)
    counted = groups.groupBy("group", "doc_id", "hash").agg(F.count(F.lit(1)).alias("n"))
    least = counted.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "n")).alias("k"))
    keep = cut(least.select(F.col("k.doc_id").alias("_barloom_id"), F.col("k.hash").alias("_barloom_hash"), F.col("k.n").alias("_barloom_n")), "keep")
    held = docs.withColumn("_barloom_h", F.xxhash64(F.col(text)))
    chosen = lambda k: held.join(k, held[doc_id].cast("long").eqNullSafe(k["_barloom_id"]) & (held["_barloom_h"] == k["_barloom_hash"]), "left_semi")
    # Of rows with one doc_id and text, any one stays.
    once, more = chosen(keep.where("_barloom_n = 1")), chosen(keep.where("_barloom_n > 1")).dropDuplicates([doc_id, "_barloom_h"])
    return once.unionByName(more).drop("_barloom_h")

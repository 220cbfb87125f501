"""The trie of conversations by their first turns, by prefix doubling.

Turns get dense names, then aligned blocks of 2, 4, 8, ... turns do, each from the names of its halves: a join round for
each power of two. A prefix is a block for each bit of its length, longest first, so as many rounds more name all prefixes;
a name is a node. What nodes say of their subtrees needs no walk: of the conversations through a node the smallest owns
it, a conversation owns its prefixes from some length on (those are a chain of the trie), and sums over a subtree are
sums over its members of what lies below on their own prefixes. Every step groups or joins; no task holds a conversation,
a node's members or a level of the trie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut, lookup
from barloom.llm.sequences import dense, in_turn_order, joined_sha256, numbered, total

#: SHA-256 of no bytes.
NOTHING = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def rebuilt(conversations: DataFrame, family: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of the first of their family.

    Conversation c takes the first crc32(c) % heads turns of conversation c - c % family (all if fewer, none if absent),
    then its own turns after as many. Returns turns (conv_id, pos, turn_md5, chars) and conversations (conv_id, length).
    """
    said = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    )
    ordered = in_turn_order(said).select("conv_id", "turn_md5", F.length("text").cast("long").alias("chars"))
    turns = numbered(ordered, "conv_id", "turns")
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("taken")
    own = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("n")).withColumns({"taken": taken, "base": F.col("conv_id") - F.col("conv_id") % family})
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    head = F.least("taken", F.coalesce("base_n", F.lit(0)))
    convs = cut(own.join(bases, "base", "left").select("conv_id", "base", "taken", head.alias("head"), (head + F.greatest(F.col("n") - F.col("taken"), F.lit(0))).alias("length")), "convs")
    # A first conversation has fewer than `heads` turns here, and fewer than 2 x `family` others take them.
    first = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "base")
    given = first.join(convs.where("head > 0"), "base").where("pos < head").select("conv_id", "pos", "turn_md5", "chars")
    left = turns.withColumn("taken", taken).where("pos >= taken")
    short = convs.where("head < taken").select("conv_id", (F.col("taken") - F.col("head")).alias("less"))
    kept = lookup(left, "conv_id", "pos", short, "left").select("conv_id", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("pos"), "turn_md5", "chars")
    return given.unionByName(kept), convs.select("conv_id", "length")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first turns, the empty one included.

    turns: conv_id, pos (from 0, without gaps), turn_md5 (of role and text), chars. convs: conv_id, length (0 for none).
    Returns conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    No conversations make no nodes.
    """
    longest = convs.agg(F.max("length")).first()[0] or 0
    rounds = longest.bit_length()
    words, _ = dense(turns.select("turn_md5").distinct(), 0, "names")
    block = cut(lookup(turns, "turn_md5", "conv_id", words).select("conv_id", "pos", "name", "chars", F.col("chars").alias("last")), "blocks")
    levels = [block]
    for _ in range(1, rounds):
        odd = F.col("pos") % 2 == 1
        of = lambda c, side: F.max(F.when(side, F.col(c)))  # noqa: E731  a block has one of each
        halves = block.groupBy("conv_id", F.shiftright("pos", 1).alias("pos")).agg(of("name", ~odd).alias("l"), of("name", odd).alias("r"), F.sum("chars").alias("chars"), of("last", odd).alias("last")).where("r IS NOT NULL")
        halves = cut(halves, "halves")
        pairs, _ = dense(halves.select("l", "r").distinct(), 0, "names")
        block = cut(lookup(halves, ["l", "r"], "conv_id", pairs).select("conv_id", "pos", "name", "chars", "last"), "blocks")
        levels.append(block)

    prefixes, names = cut(convs.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in ("depth", "name", "chars", "last"))), "prefixes"), 1
    for k in range(rounds - 1, -1, -1):
        block = levels[k].where("pos % 2 = 0").select("conv_id", (F.col("pos") * (1 << k)).alias("depth"), F.col("name").alias("r"), F.col("chars").alias("more"), F.col("last").alias("_last"))
        longer = prefixes.join(block, ["conv_id", "depth"]).select("conv_id", (F.col("depth") + (1 << k)).alias("depth"), F.col("name").alias("l"), "r", (F.col("chars") + F.col("more")).alias("chars"), F.col("_last").alias("last"))
        longer = cut(longer, "longer")
        pairs, n = dense(longer.select("l", "r").distinct(), names, "names")
        names += n
        prefixes = prefixes.unionByName(cut(lookup(longer, ["l", "r"], "conv_id", pairs).select("conv_id", "depth", "name", "chars", "last"), "prefixes"))

    # Who owns what.
    nodes = cut(prefixes.groupBy("name").agg(F.min("conv_id").alias("owner"), F.max("depth").alias("depth")), "nodes")
    chains = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("top"))
    convs = convs.join(chains, "conv_id", "left").withColumn("top", F.coalesce("top", F.col("length") + 1))
    places = convs.select("conv_id", "length", "top", F.explode(F.array(F.col("top") - 1, "length")).alias("depth")).distinct()
    at = places.join(prefixes, ["conv_id", "depth"], "left")
    above = F.col("depth") == F.col("top") - 1
    convs = at.groupBy("conv_id", "length", "top").agg(
        F.max(F.when(above, F.col("name"))).alias("parent"), F.coalesce(F.max(F.when(above, F.col("chars"))), F.lit(0)).alias("shared"), F.max(F.when(F.col("depth") == F.col("length"), F.col("name"))).alias("end"),
    )
    convs = cut(convs, "chains")
    owners = convs.where("top <= length")
    grown = cut(owners.where("top > 0").groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("grown")), "grown")
    # An owner's end is a node of its own.
    leaves = owners.join(grown.select(F.col("name").alias("end")), "end", "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    parents = lookup(owners.where("top > 0").select("conv_id", F.col("parent").alias("name")), "name", "conv_id", nodes.select("name", F.col("owner").alias("parent_owner"))).select("conv_id", "parent_owner")
    known = cut(convs.select("conv_id", "length", "top", "shared").join(leaves, "conv_id", "left").join(parents, "conv_id", "left"), "owners")

    rows = lookup(prefixes, "conv_id", "depth", known)
    shared = F.when(F.col("depth") < F.col("top"), F.col("shared") - F.col("chars")).otherwise(F.lit(0))
    summed = rows.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("last").alias("last"), total(F.col("leaf")).alias("n_leaves"), F.sum(shared).alias("below"),
        F.min_by(F.struct("length", "top", "parent_owner"), "conv_id").alias("own"),
    )
    ends = joined_sha256(convs.select("end", "conv_id", F.col("conv_id").cast("string").alias("id")), ["end"], ["conv_id"], "id", ",")
    out = summed.join(grown, "name", "left").join(ends.withColumnRenamed("end", "name"), "name", "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("own.top"), F.col("conv_id")).otherwise(F.col("own.parent_owner")).alias("parent_conv_id"), "n_convs",
        (F.coalesce("grown", F.lit(0)) + (F.col("own.length") > F.col("depth")).cast("long")).alias("n_children"), "n_leaves",
        (F.col("below") + (F.col("n_convs") - 1) * F.col("last")).alias("saved_tokens"), F.coalesce("sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )


def shared_prefixes(conversations: DataFrame) -> DataFrame:
    """trie() of rebuilt() conversations (conv_id, turn, role, text).

    Null role and text are empty. Turns are in order of turn (null first), ties as in_turn_order() says, so repeated rows
    and ties have one order. Rows without a conv_id belong to no conversation. Other columns don't matter. Turns are told
    apart by MD5 of role and text.
    """
    return trie(*rebuilt(conversations))

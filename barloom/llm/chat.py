"""Chat formatting by perspective: each participant of a dialogue once as the assistant, the others as named users."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.common import lookup

#: Neighbouring turn numbers that are rendered in one row.
PART_TURNS = 64
#: Turns of one part at most, where it is asked that parts be bounded (many turns with one number).
CROWDED = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _plain(text: Column) -> Column:
    """The text without anything that reads as a control token; null is empty."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _pieces(said: DataFrame, most: int) -> DataFrame:
    """said with _piece: the turn's place in its block, in the order of turns, divided by `most`.

    Places are worked out in blocks of more turns alone: counts per turn, role and two hex digits of the MD5, summed
    up in order, and the place among those turns.
    """
    key = ["conv_id", "_block"]
    same = lambda a, b, names: reduce(and_, (a[c].eqNullSafe(b[f"_of_{c}"]) for c in names))
    named = lambda d, names: d.select(*(F.col(c).alias(f"_of_{c}") for c in names), *(c for c in d.columns if c not in names))
    crowd = named(said.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*key), key)
    fine = [*key, "turn", "role", "_hex"]
    full = said.join(crowd, same(said, crowd, key), "left_semi").withColumn("_hex", F.substring("_order", 1, 2))
    counts = full.groupBy(*fine).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy(*key).orderBy("turn", "role", "_hex").rowsBetween(W.unboundedPreceding, -1))
    counts = named(counts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("n"), fine)
    placed = full.join(counts, same(full, counts, fine)).withColumn("_at", F.row_number().over(W.partitionBy(*fine).orderBy("_order")) - 1)
    placed = placed.select(*said.columns, F.floor((F.col("_before") + F.col("_at")) / most).alias("_piece"))
    rest = said.join(crowd, same(said, crowd, key), "left_anti")
    return rest.withColumn("_piece", F.lit(0).cast("long")).unionByName(placed)


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: tuple[str, ...] = ("system",), most: int | None = CROWDED) -> DataFrame:
    """A row per conversation, participant and part: conv_id, perspective, part, n_turns, text, mask.

    Participants are all roles of a conversation but those in `system`, which are rendered as such for everyone. Turns
    are in order of turn number, role, MD5 of the text. The perspective's own turns are "assistant", all others
    "user name=<role>"; mask lists (start, length), in characters of the part's text, of what the assistant says, with
    its closing token and line end. Parts are blocks of turn numbers (0 to PART_TURNS - 1, and so on), numbered in
    order; their texts joined in order are the dialogue. A block comes in parts of `most` neighbouring turns, the last
    with the rest; with None each block is one part. No task holds more than a part, however long the conversation.

    Null ids are a conversation like any other; null turn numbers come last; a null role is named "" ; null and empty
    texts are turns without content; rows that repeat conversation, number, role and text are one turn; "<|" in roles
    and texts is written "< |", and a line end in a role is a space. A conversation of system turns alone has no participant and no row. Other columns do
    not matter.
    """
    named = F.translate(_plain(F.col(role)), "\r\n", "  ")
    said = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), named.alias("role"), _plain(F.col(text)).alias("text")).distinct()
    said = said.withColumn("_order", F.md5(F.col("text").cast("binary"))).withColumn("_block", F.floor(F.col("turn") / PART_TURNS))
    said = said.withColumn("_piece", F.lit(0).cast("long")) if most is None else _pieces(said, most)
    # Keys as structs, in which nulls are equal.
    said = said.withColumns({"_conv": F.struct("conv_id"), "_part": F.struct("conv_id", "_block", "_piece")})
    number = F.row_number().over(W.partitionBy("_conv").orderBy(F.col("_block").asc_nulls_last(), "_piece")) - 1
    numbers = said.select("_conv", "_part", "_block", "_piece").distinct().select("_part", number.alias("part"))
    turn_list = F.sort_array(F.collect_list(F.struct("turn", "role", "_order", "text"))).alias("turns")
    parts = said.groupBy("_part", "_conv").agg(turn_list).join(numbers, "_part")
    people = said.where(~F.col("role").isin(*map(str, system))).groupBy("_conv").agg(F.collect_set("role").alias("people"))
    seen = lookup(parts, "_conv", "_part", people).withColumn("perspective", F.explode("people")).withColumn("conv_id", F.col("_conv.conv_id"))

    mine = lambda t: t["role"] == F.col("perspective")
    head = lambda t: F.concat(F.lit(OPEN), F.when(t["role"].isin(*map(str, system)), t["role"]).when(mine(t), "assistant").otherwise(F.concat(F.lit("user name="), t["role"])), F.lit("\n"))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"), mine(t).alias("mine")))
    span = lambda at, p: F.struct((at + F.length(p["head"])).cast("int").alias("start"), F.length(p["body"]).alias("length"))
    none = F.array().cast("array<struct<start:int,length:int>>")
    walked = F.aggregate(
        "pieces", F.struct(F.lit(0).alias("at"), none.alias("mask")),
        lambda s, p: F.struct((s["at"] + F.length(p["head"]) + F.length(p["body"])).alias("at"), F.when(p["mine"], F.concat(s["mask"], F.array(span(s["at"], p)))).otherwise(s["mask"]).alias("mask")),
        lambda s: s["mask"],
    )
    return seen.withColumn("pieces", pieces).select(
        "conv_id", "perspective", "part", F.size("turns").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("text"), walked.alias("mask"),
    )

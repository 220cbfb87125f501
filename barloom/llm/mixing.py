"""Mixing sources to target weights by capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def word_count(text: str) -> Column:
    """Words of the text, parted by ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: Column, epochs: float) -> DataFrame:
    """sources (source, weight, size) with target: weight shares of the budget, none above epochs * size.

    What a capped source cannot take is shared again by weight until none is above its cap. That fixed point has a
    closed form: with sources in order of cap/weight, the level over those not yet capped rises up to the first source
    whose cap is not reached and falls from there; that highest level holds: those before it are capped, and
    the others get weight * level. The table has one row per source; its running sums are windows over it.
    """
    cap = F.lit(float(epochs)) * F.col("size")
    order = W.orderBy("_ratio", "_rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(0, W.unboundedFollowing)
    filled = (
        sources.withColumn("_ratio", cap / F.col("weight"))
        .withColumn("_budget", budget)
        .withColumn("_level", (F.col("_budget") - F.lit(float(epochs)) * F.coalesce(F.sum("size").over(before), F.lit(0))) / F.sum("weight").over(rest))
        .withColumn("_level", F.max(F.when(F.col("_ratio") >= F.col("_level"), F.col("_level"))).over(W.partitionBy()))
    )
    target = F.when(F.col("_level").isNull() | (F.col("_ratio") <= F.col("_level")), cap).otherwise(F.col("weight") * F.col("_level"))
    return filled.withColumn("target", target).drop("_ratio", "_budget", "_level")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: float = 3.0, seed: int = 7, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """docs with size, source_size, target, taken (words) and times (repetitions that the mix takes).

    Sources by code point, null last, weigh `weights` in turn; all together get as many words as all have, and none
    more than epochs times its own. A source's rate is target / source_size: each of its rows is taken floor(rate)
    times, and the rest of the target is filled with one more repetition of rows in a seeded order, up to the row
    whose middle passes it. Taken words differ from the target by half a row at most. Reruns agree; rows that repeat
    a doc_id follow each other by size. Empty and null texts have size 0 and are taken floor(rate) times; a capped
    source's rows are taken exactly epochs times. Columns of docs named as one of the new ones are replaced; others stay.

    The seeded order is by MD5 of seed and doc_id. Its first two and next two hex digits are buckets, so running sums
    over a source, however large, are sums over 256 buckets, 256 parts of each, and the rows of one part.
    """
    docs = docs.drop("size", "source_size", "target", "taken", "times")
    rows = docs.withColumns({
        "size": word_count(text),
        "_mix_hash": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))).cast("binary")),
        "_mix_source": F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("")),
    }).withColumns({"_mix_b1": F.substring("_mix_hash", 1, 2), "_mix_b2": F.substring("_mix_hash", 3, 2)})
    parts = rows.groupBy("_mix_source", "_mix_b1", "_mix_b2").agg(F.sum("size").alias("part_size"))
    buckets = parts.groupBy("_mix_source", "_mix_b1").agg(F.sum("part_size").alias("bucket_size"))
    sums = buckets.groupBy("_mix_source").agg(F.sum("bucket_size").alias("size"))
    kinds = len(weights)
    turn = F.pmod(F.col("_rank") - 1, F.lit(kinds))
    ranked = sums.withColumn("_rank", F.row_number().over(W.orderBy(F.col("_mix_source") == "", "_mix_source"))).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    )
    filled = water_fill(ranked, F.sum("size").over(W.partitionBy()), epochs).withColumnRenamed("size", "source_size")
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    filled = filled.withColumn("_mix_whole", rate.cast("long")).withColumn("_mix_rest", F.col("target") - F.col("_mix_whole") * F.col("source_size")).select("_mix_source", "source_size", "target", "_mix_whole", "_mix_rest")

    def running(of: str, *key: str, by: list[str]) -> Column:
        return F.coalesce(F.sum(of).over(W.partitionBy(*key).orderBy(*by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    buckets = buckets.withColumn("_mix_at1", running("bucket_size", "_mix_source", by=["_mix_b1"])).join(filled, "_mix_source")
    parts = parts.withColumn("_mix_at2", running("part_size", "_mix_source", "_mix_b1", by=["_mix_b2"])).join(buckets, ["_mix_source", "_mix_b1"])
    parts = parts.withColumn("_mix_at", F.col("_mix_at1") + F.col("_mix_at2")).select("_mix_source", "_mix_b1", "_mix_b2", "_mix_at", "source_size", "target", "_mix_whole", "_mix_rest")
    place = F.col("_mix_at") + running("size", "_mix_source", "_mix_b1", "_mix_b2", by=["_mix_hash", doc_id, "size"]) + F.col("size") / 2
    mixed = rows.join(parts, ["_mix_source", "_mix_b1", "_mix_b2"]).withColumn("times", F.col("_mix_whole") + F.when((F.col("size") > 0) & (F.col("_mix_rest") > 0) & (place <= F.col("_mix_rest")), 1).otherwise(0))
    return mixed.withColumn("taken", F.col("size") * F.col("times")).drop("_mix_source", "_mix_b1", "_mix_b2", "_mix_at", "_mix_hash", "_mix_whole", "_mix_rest")

"""Shuffled mini-batches of a table, in an order that depends on a seed and each row's key alone."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.storage import scratch
from barloom.functions.sums import summed
from barloom.functions.windows import bucket_of


def shuffled_batches(df: DataFrame, key: Sequence[str], size: int, seed: int = 7, whole: bool = True) -> DataFrame:
    """df with batch (0, 1, ...) and place (0 .. size - 1): a permutation of the rows cut into batches of `size`.

    Rows are in order of MD5 of the seed and their key, so reruns agree and new splits of files change nothing. The first
    four digits of that are a bucket: rows are ordered within 65,536 buckets side by side, and a bucket's place is the sum of
    the counts before it. whole: rows that don't fill a last batch are left out. Rows of equal keys share a hash; the key
    must tell rows apart for reruns to agree.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in key))
    d = df.withColumn("_h", F.md5(text.cast("binary"))).withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    counts = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_b", (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_start"), F.sum("_n").over(W.partitionBy()).alias("_all"))
    d = d.join(F.broadcast(starts), "_b")  # 65,536 rows at most
    d = d.withColumn("_at", F.col("_start") + F.row_number().over(W.partitionBy("_b").orderBy("_h")) - 1)
    if whole:
        d = d.where(F.col("_at") < F.col("_all") - F.col("_all") % size)
    return d.withColumns({"batch": F.floor(F.col("_at") / size), "place": (F.col("_at") % size).cast("int")}).drop("_h", "_b", "_start", "_all", "_at")


def intersection_windows(df: DataFrame, value: str, assets: Sequence[str], n: int, ts: str = "ts", every: str = "1 day") -> DataFrame:
    """ts, sequence: of times that all assets have, the last n such times' values of all assets (an array of n arrays).

    A window may look at the time bucket before its own, so buckets must hold n times; windows that would look further are
    left out. A task holds a bucket and the one before.
    """
    wide = df.where(F.col("asset").isin(*assets)).groupBy(ts).pivot("asset", [*assets]).agg(F.first(value)).dropna(subset=[*assets])
    held = wide.select(ts, F.array(*(F.col(f"`{a}`").cast("double") for a in assets)).alias("row")).withColumn("_b", bucket_of(wide.select(ts), ts, every))
    step = F.expr(f"INTERVAL {every}")
    both = held.withColumn("_own", F.lit(True)).unionByName(held.withColumn("_b", F.col("_b") + step).withColumn("_own", F.lit(False)))
    seq = F.collect_list("row").over(W.partitionBy("_b").orderBy(ts).rowsBetween(1 - n, 0))
    return both.withColumn("sequence", seq).where(F.col("_own") & (F.size("sequence") == n)).select(ts, "sequence")


def descend(rows: DataFrame, key: Sequence[str], gradient: Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray], theta: np.ndarray, rounds: int, size: int, rate: float) -> np.ndarray:
    """Weights after so many rounds of Adam from theta, each on one shuffled mini-batch of at most `size` rows.

    gradient(theta, columns of some rows but the key): summed over them. Batches are written once, a folder each, so a round
    reads one; it is a job that returns as many numbers as there are weights. With fewer rows all are one batch.
    """
    n = rows.count()
    if not n:
        raise ValueError("no rows to train on")
    size, at = min(size, n), scratch(rows.sparkSession)
    names = [c for c in rows.columns if c not in key]
    shuffled_batches(rows, key, size).select("batch", *names).repartition("batch", F.pmod("place", F.lit(32))).write.partitionBy("batch").parquet(at)
    held = rows.sparkSession.read.parquet(at)
    m, v = np.zeros(len(theta)), np.zeros(len(theta))
    for t in range(1, rounds + 1):
        now = theta.copy()

        def add(b: dict[str, np.ndarray], now: np.ndarray = now) -> np.ndarray:
            out = np.zeros(len(now))
            for lo in range(0, len(b[names[0]]), 512):
                out += gradient(now, {c: x[lo : lo + 512] for c, x in b.items()})
            return out

        g = summed(held.where(F.col("batch") == (t - 1) % (n // size)), names, add, len(theta)) / size
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta

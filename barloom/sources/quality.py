"""Checks of bars, each a small report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import Roll, bounded


def time_report(df: DataFrame, by: Sequence[str] = ("asset",), ts: str = "ts", earliest: str = "2010-01-01") -> DataFrame:
    """Per asset: rows, null, repeated and too early times, first and last."""
    held = df.groupBy(*by, ts).agg(F.count(F.lit(1)).alias("_n"))
    return held.groupBy(*by).agg(
        F.sum("_n").alias("rows"), F.coalesce(F.sum(F.when(F.col(ts).isNull(), F.col("_n"))), F.lit(0)).alias("null_ts"),
        F.coalesce(F.sum(F.when(F.col(ts).isNotNull(), F.col("_n") - 1)), F.lit(0)).alias("repeated_ts"),
        F.coalesce(F.sum(F.when(F.col(ts) < F.lit(earliest).cast("timestamp_ntz"), F.col("_n"))), F.lit(0)).alias("early_ts"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
    )


@bounded(lambda a: 1)
def _stepped(df: DataFrame, by: Sequence[str] = ("asset",)) -> DataFrame:
    return df.withColumn("_s", F.timestamp_diff("SECOND", Roll(by).lag("ts"), F.col("ts")))


def interval_report(df: DataFrame, seconds: int, by: Sequence[str] = ("asset",)) -> DataFrame:
    """Per asset the share of steps of exactly one bar, and a grade: good from 0.95, fair from 0.9."""
    out = _stepped(df, by=by).groupBy(*by).agg(F.count("_s").alias("steps"), F.avg((F.col("_s") == seconds).cast("double")).alias("share"))
    return out.withColumn("grade", F.when(F.col("share") >= 0.95, "good").when(F.col("share") >= 0.9, "fair").otherwise("poor"))


def ohlc_report(df: DataFrame, by: Sequence[str] = ("asset",)) -> DataFrame:
    """Per asset: nulls, prices that are not positive, highs and lows inside the body, volumes of zero and below."""
    price = ("open", "high", "low", "close")
    any_ = lambda f: F.count_if(f)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), *(any_(F.col(c).isNull()).alias(f"null_{c}") for c in (*price, "volume")), *(any_(F.col(c) <= 0).alias(f"bad_{c}") for c in price),
        any_(F.col("high") < F.greatest("open", "close")).alias("bad_high_low"), any_(F.col("low") > F.least("open", "close")).alias("bad_low_high"),
        any_(F.col("volume") == 0).alias("zero_volume"), any_(F.col("volume") < 0).alias("negative_volume"),
    )

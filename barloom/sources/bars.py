"""Bars from ticks and files, an incremental cache, and dedup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.windows import by_time, running_sum

SCHEMA = "asset STRING, ts TIMESTAMP_NTZ, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"


def bars(ticks: DataFrame, asset: str | Column, price: str | Column, ts: str, every: str, order: Sequence[str], volume: Column | None = None) -> DataFrame:
    """OHLCV bars labelled by their start. One partial aggregation: a hot asset is summed before it is shuffled.

    order: columns after ts that break ties for open and close.
    """
    t = ticks.select(
        (F.col(asset) if isinstance(asset, str) else asset).cast("string").alias("asset"), (F.col(price) if isinstance(price, str) else price).alias("_p"),
        F.struct(ts, *order).alias("_o"), by_time(ts, every).alias("ts"), (F.lit(1.0) if volume is None else volume).cast("double").alias("_v"),
    )
    return t.groupBy("asset", "ts").agg(
        F.min_by("_p", "_o").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.max_by("_p", "_o").alias("close"), F.sum("_v").alias("volume")
    )


def event_bars(spark: SparkSession, sf_dir: str, every: str = "1 hour") -> DataFrame:
    return bars(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "value", "ts", every, ["event_id"])


def resample(df: DataFrame, every: str, by: Sequence[str] = ("asset",)) -> DataFrame:
    """Longer bars from shorter ones."""
    return df.withColumn("_b", by_time("ts", every)).groupBy(*by, "_b").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    ).withColumnRenamed("_b", "ts")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def from_klines(rows: DataFrame) -> DataFrame:
    """Exchange rows (epoch milliseconds and numbers as strings) as bars; turnover is dropped, bad numbers are null."""
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)").alias(c)
    return rows.select("asset", F.expr("CAST(timestamp_millis(CAST(timestamp AS BIGINT)) AS TIMESTAMP_NTZ)").alias("ts"), *map(number, ("open", "high", "low", "close", "volume")))


def write(df: DataFrame, path: str, form: str = "parquet", by: Sequence[str] = ("asset",)) -> None:
    """Parquet in folders by asset and sorted by time, a file for each month of an asset at most; or CSV or JSON."""
    if form == "parquet":
        df.repartition(*by, F.date_trunc("month", F.col("ts"))).sortWithinPartitions(*by, "ts").write.partitionBy(*by).mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").option("header", True).format(form).save(path)


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in that order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("asset", "ts")) -> DataFrame:
    """Old rows, and new ones whose key is not there yet."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def between(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Rows from start to end, both included; the filter reaches the scan."""
    kind = df.schema[ts].dataType
    return df.where(F.col(ts).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def lookback(end: str | Column, days: int = 0, hours: int = 0, minutes: int = 0) -> Column:
    """A moment so long before `end`."""
    end = F.col(end) if isinstance(end, str) else end
    return end - F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes))


def union(parts: dict[str, DataFrame]) -> DataFrame:
    """One panel of several assets' bars."""
    frames = [df.withColumn("asset", F.lit(a)) for a, df in parts.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def synthetic(spark: SparkSession, assets: int = 3, rows: int = 1000, seed: int = 42, every: int = 3600) -> DataFrame:
    """Seeded random-walk bars: a made-up return per row, prices by a running sum."""
    r = spark.range(assets * rows).select(
        F.concat(F.lit("A"), F.floor(F.col("id") / rows).cast("string")).alias("asset"),
        F.expr(f"CAST(timestamp_seconds(1704067200 + (id % {rows}) * {every}) AS TIMESTAMP_NTZ)").alias("ts"), (F.randn(seed) * 0.01).alias("_r"), (F.rand(seed + 1) * 100).alias("volume"),
    )
    r = running_sum(r, F.col("_r"), "_sum").withColumn("close", 100 * F.exp("_sum")).withColumn("open", F.col("close") * F.exp(-F.col("_r")))
    return r.select("asset", "ts", "open", (F.greatest("open", "close") * 1.001).alias("high"), (F.least("open", "close") * 0.999).alias("low"), "close", "volume")


def latest(df: DataFrame, n: int, by: Sequence[str] = ("asset",), ts: str = "ts") -> DataFrame:
    """The last n rows of each key; Spark keeps n of a key in each task before rows are shuffled."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(F.col(ts).desc()))).where(F.col("_n") <= n).drop("_n")

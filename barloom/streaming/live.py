"""Bars and signals of a stream of ticks, with the batch functions' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ticks(spark: SparkSession, folder: str, name: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of ticks with that name in a folder, and those that come, as a stream."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", name)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).parquet(folder)


def stream_bars(ticks: DataFrame, asset: str = "event_type", price: str = "value", ts: str = "ts", tie: str = "event_id", every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """OHLCV bars of tumbling windows; ticks later than the watermark are dropped. State is one row per open bar."""
    t = ticks.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    g = t.groupBy(F.col(asset).alias("asset"), F.window("_at", every).alias("w")).agg(
        F.min_by(price, F.struct("_at", tie)).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, F.struct("_at", tie)).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
    )
    return g.select("asset", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def run(bars: DataFrame, sink: str, checkpoint: str, score: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> StreamingQuery:
    """Write finished bars (scored batch by batch, if asked) to Parquet, with what is available now. A batch that is run
    again after a failure writes to its own folder again, so rows appear once."""

    def write(batch: DataFrame, number: int) -> None:
        out = score(batch) if score else batch
        out.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={number}")

    return bars.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def decision(df: DataFrame, *states: str) -> DataFrame:
    """The triple-timeframe decision: long if all are Bull, short if all are Bear, else flat."""
    from barloom.operators.trading import confluence

    return named(confluence(df, *states))


def named(df: DataFrame) -> DataFrame:
    """decision in words of a signal of 1, -1 or 0."""
    return df.withColumn("decision", F.when(F.col("signal") == 1, "long").when(F.col("signal") == -1, "short").otherwise("flat"))


def plain_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """A stream's moments as the wall times (of the session's zone) that bars of tables have."""
    return df.withColumn(ts, F.expr(f"to_timestamp_ntz(date_format({ts}, 'yyyy-MM-dd HH:mm:ss'))"))

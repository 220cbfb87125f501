"""A cache of bars on shared storage that knows which times of which assets it has.

bars: Parquet by asset and month. coverage: versions of a table of half-open times (asset, since, until) whose bars are
there, be there any or not. A request subtracts these intervals from the wanted ones, fetches the rest, rewrites the months
it touches and only then notes the new times. A request that fails on the way leaves the coverage as it was, and the next
one fetches and rewrites the same months again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.storage import written
from barloom.sources.bars import SCHEMA

TIMES = "asset STRING, since TIMESTAMP_NTZ, until TIMESTAMP_NTZ"
MONTH = "_month"
BARS = ["asset", "ts", "open", "high", "low", "close", "volume"]


def merged(times: DataFrame) -> DataFrame:
    """The same times with intervals that meet or overlap as one; empty ones go."""
    w = W.partitionBy("asset").orderBy("since", "until")
    d = times.where("since < until").withColumn("_reach", F.max("until").over(w.rowsBetween(W.unboundedPreceding, -1)))
    d = d.withColumn("_island", F.sum(F.when(F.col("since") <= F.col("_reach"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.groupBy("asset", "_island").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("_island")


def subtract(wanted: DataFrame, had: DataFrame) -> DataFrame:
    """The times in wanted that aren't in had. Both are merged first; work grows with the intervals of an asset, not their pairs.

    Ends of both are put in one order: a time is missing where wanted is open and had is not.
    """
    ends = lambda d, name: merged(d).select("asset", F.explode(F.array(F.struct(F.col("since").alias("at"), F.lit(1).alias(name)), F.struct(F.col("until").alias("at"), F.lit(-1).alias(name)))).alias("e")).select("asset", "e.*")
    both = ends(wanted, "_w").unionByName(ends(had, "_h"), allowMissingColumns=True)
    both = both.groupBy("asset", "at").agg(F.coalesce(F.sum("_w"), F.lit(0)).alias("_w"), F.coalesce(F.sum("_h"), F.lit(0)).alias("_h"))
    w = W.partitionBy("asset").orderBy("at")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    both = both.select("asset", F.col("at").alias("since"), F.lead("at").over(w).alias("until"), F.sum("_w").over(upto).alias("_w"), F.sum("_h").over(upto).alias("_h"))
    return merged(both.where("_w > 0 AND _h = 0").select("asset", "since", "until"))


class BarCache:
    """fetch: times (asset, since, until) -> bars (asset, ts, open, high, low, close, volume) of them; rows outside, or without an asset, are left out."""

    def __init__(self, spark: SparkSession, path: str, fetch: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.fetch = spark, path.rstrip("/"), fetch

    def _fs(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _version(self) -> int:
        """The latest version of the coverage that was written whole; 0 if there is none."""
        fs, path = self._fs(f"{self.path}/coverage")
        if not fs.exists(path):
            return 0
        names = [s.getPath() for s in fs.listStatus(path)]
        return max((int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and fs.exists(self._fs(f"{p}/_SUCCESS")[1])), default=0)

    def coverage(self) -> DataFrame:
        n = self._version()
        return self.spark.read.schema(TIMES).parquet(f"{self.path}/coverage/v={n}") if n else self.spark.createDataFrame([], TIMES)

    def _note(self, times: DataFrame) -> None:
        """times as the next version; a version that was begun and not ended is written over. The one before stays, for readers that have begun."""
        n = self._version()
        times.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/coverage/v={n + 1}")
        if n > 1:
            fs, path = self._fs(f"{self.path}/coverage/v={n - 1}")
            fs.delete(path, True)

    def _bars(self) -> DataFrame:
        fs, path = self._fs(f"{self.path}/bars")
        kinds = f"{SCHEMA}, {MONTH} STRING"
        return self.spark.read.schema(kinds).parquet(f"{self.path}/bars") if fs.exists(path) else self.spark.createDataFrame([], kinds)

    def bars(self) -> DataFrame:
        """All bars that are there."""
        return self._bars().drop(MONTH)

    def missing(self, wanted: DataFrame) -> DataFrame:
        return subtract(wanted, self.coverage())

    def get(self, wanted: DataFrame, refresh: bool = False) -> DataFrame:
        """The bars of the wanted times, of which those that aren't there yet (with refresh: all) are fetched first."""
        gaps = written(merged(wanted) if refresh else self.missing(wanted))
        if not gaps.isEmpty():
            self._put(_within(self.fetch(gaps).select(*BARS), gaps), gaps)
            self._note(merged(self.coverage().unionByName(gaps)))
        return _within(self._bars(), merged(wanted))

    def clear(self, times: DataFrame | None = None) -> None:
        """Forget these times, or everything."""
        if times is None:
            fs, path = self._fs(self.path)
            fs.delete(path, True)
            return
        # First the coverage: bars of times that it doesn't have are fetched again, whatever became of them.
        self._note(written(subtract(self.coverage(), times)))
        self._put(self.spark.createDataFrame([], SCHEMA), merged(times))

    def _put(self, new: DataFrame, times: DataFrame) -> None:
        """new in place of what the months that they touch have of these times."""
        month = F.date_format("ts", "yyyy-MM").alias(MONTH)
        touched = _months(times).select("asset", MONTH).distinct()
        held = self._bars().join(touched, ["asset", MONTH], "left_semi")
        gone = _within(held, times).select("asset", "ts")
        left = written(held.drop(MONTH).join(gone, ["asset", "ts"], "left_anti").unionByName(new.select(*(c for c in held.columns if c != MONTH))))
        rows = left.dropDuplicates(["asset", "ts"]).withColumn(MONTH, month)
        rows.repartition("asset", MONTH).sortWithinPartitions("asset", MONTH, "ts").write.partitionBy("asset", MONTH).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/bars")
        # A month that has lost all its bars isn't in what was written: its folder goes.
        empty = touched.join(left.select("asset", month).distinct(), ["asset", MONTH], "left_anti").collect()
        for asset, name in empty:  # one for each month asked for that has no bars
            fs, path = self._fs(f"{self.path}/bars/asset={_escaped(self.spark, asset)}/{MONTH}={name}")
            fs.delete(path, True)


def _escaped(spark: SparkSession, name: str) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)


def _months(times: DataFrame) -> DataFrame:
    """times, once for each month that they touch."""
    ends = (F.date_trunc("month", c).cast("date") for c in (F.col("since"), F.col("until") - F.expr("INTERVAL 1 MICROSECOND")))
    month = F.explode(F.sequence(*ends, F.expr("INTERVAL 1 MONTH")))
    return times.select("*", month.alias("_d")).select("asset", "since", "until", F.date_format("_d", "yyyy-MM").alias(MONTH))


def _within(bars: DataFrame, times: DataFrame) -> DataFrame:
    """The bars of these times (merged, so that a bar lies in one at most); an asset's bars meet its times by month."""
    held = bars if MONTH in bars.columns else bars.withColumn(MONTH, F.date_format("ts", "yyyy-MM"))
    return held.join(_months(times), ["asset", MONTH]).where("ts >= since AND ts < until").select(*(c for c in bars.columns if c != MONTH))

"""Forward-looking labels, excursions, sample weights, chronological splits and leakage checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.windows import Roll, bounded, ratio

By = Sequence[str]
ASSET = ("asset",)


@bounded(ahead=lambda a: a["n"])
def forward_return(df: DataFrame, n: int = 36, threshold: float = 0.005, price: str = "close", by: By = ASSET) -> DataFrame:
    """fwd_ret after n bars and label (1 above the threshold); both null past the end of the history."""
    d = df.withColumn("fwd_ret", ratio(Roll(by).lead(price, n), price) - 1)
    return d.withColumn("label", F.when(F.col("fwd_ret").isNotNull(), (F.col("fwd_ret") > threshold).cast("int")))


@bounded(ahead=lambda a: a["n"])
def first_hits(df: DataFrame, up: Column, down: Column, n: int, by: By = ASSET) -> DataFrame:
    """tp_at and sl_at: bars until the high reaches `up` and the low reaches `down` (null: not within n bars); ahead: bars there are."""
    w = Roll(by).w.rowsBetween(1, n)
    d = df.withColumns({"_hs": F.collect_list("high").over(w), "_ls": F.collect_list("low").over(w), "_up": up, "_dn": down})
    at = lambda xs, hit: F.array_min(F.filter(F.transform(xs, lambda x, k: F.when(hit(x), k + 1)), lambda k: k.isNotNull()))
    d = d.withColumns({"tp_at": at("_hs", lambda x: x >= F.col("_up")), "sl_at": at("_ls", lambda x: x <= F.col("_dn")), "ahead": F.size("_hs")})
    return d.drop("_hs", "_ls", "_up", "_dn")


def _won(n: int) -> Column:
    """1 if the profit barrier came strictly before the loss barrier; null in the last n rows."""
    return F.when(F.col("ahead") >= n, (F.col("tp_at").isNotNull() & (F.col("sl_at").isNull() | (F.col("tp_at") < F.col("sl_at")))).cast("int"))


@bounded(ahead=lambda a: a["n"])
def triple_barrier(df: DataFrame, tp: float = 0.02, sl: float = 0.01, n: int = 36, by: By = ASSET) -> DataFrame:
    d = first_hits(df, F.col("close") * (1 + tp), F.col("close") * (1 - sl), n, by=by)
    return d.withColumn("label", _won(n)).drop("ahead")


@bounded(ahead=lambda a: a["n"])
def atr_barrier(df: DataFrame, atr: str = "atr_14", tp: float = 2.5, sl: float = 1.0, n: int = 36, least: float = 0.001, by: By = ASSET) -> DataFrame:
    """Barriers in units of atr; 0 where atr is below `least` of the price."""
    d = first_hits(df, F.col("close") + tp * F.col(atr), F.col("close") - sl * F.col(atr), n, by=by)
    quiet = F.col(atr) < least * F.col("close")
    return d.withColumn("label", F.when(F.col(atr).isNull(), None).when(quiet & (F.col("ahead") >= n), 0).otherwise(_won(n))).drop("ahead", "tp_at", "sl_at")


@bounded(ahead=lambda a: a["n"])
def excursions(df: DataFrame, tp: float = 0.02, sl: float = 0.01, n: int = 36, by: By = ASSET) -> DataFrame:
    """mfe and mae: the best and worst move up to and with the bar of the exit (a barrier, or the nth bar)."""
    w = Roll(by).w.rowsBetween(1, n)
    d = first_hits(df, F.col("close") * (1 + tp), F.col("close") * (1 - sl), n, by=by)
    d = d.withColumns({"_hs": F.collect_list("high").over(w), "_ls": F.collect_list("low").over(w)}).withColumn("exit_at", F.least("tp_at", "sl_at", "ahead"))
    some = F.col("ahead") > 0
    upto = lambda c: F.slice(c, F.lit(1), F.greatest("exit_at", F.lit(1)))
    return d.withColumns({"mfe": F.when(some, F.array_max(upto("_hs")) / F.col("close") - 1), "mae": F.when(some, F.array_min(upto("_ls")) / F.col("close") - 1)}).drop("_hs", "_ls", "ahead", "tp_at", "sl_at")


def return_weights(df: DataFrame, lo: float = 0.5, hi: float = 2.0, by: By = ASSET) -> DataFrame:
    """weight: the next bar's absolute return, scaled by the key's largest to lo..hi; lo at the end."""
    from barloom.operators.rolling import with_key

    d = with_key(forward_return(df, 1, by=by).withColumn("_a", F.abs("fwd_ret")), by, _top=F.max("_a"))
    return d.withColumn("weight", lo + (hi - lo) * F.coalesce(ratio("_a", "_top"), F.lit(0.0))).select(*df.columns, "weight")


def physics_weights(df: DataFrame, warning: str = "warning", energy: str = "energy", on_warning: float = 0.0) -> DataFrame:
    return df.withColumn("weight", F.when(F.col(warning), on_warning).otherwise(1.0) * (1 + F.col(energy)))


def time_order(df: DataFrame, ts: str = "ts") -> DataFrame:
    """ts, its place among distinct times from 0, and how many there are. Counts per day come first, so no task orders all times."""
    times = df.select(ts).distinct().withColumn("_day", F.date_trunc("day", F.col(ts)))
    days = times.groupBy("_day").agg(F.count(F.lit(1)).alias("_c"))
    w = W.orderBy("_day")
    days = days.select("_day", F.coalesce(F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"))
    return times.join(days, "_day").select(ts, (F.row_number().over(W.partitionBy("_day").orderBy(ts)) - 1 + F.col("_before")).alias("place"), "total")


def folds(df: DataFrame, n: int = 5, ts: str = "ts") -> DataFrame:
    """df with fold 1..n of the validation part that a row is in (null: train only), split on distinct times.

    Of N times each fold tests N // (n + 1), the last ones to the end; a fold trains on all times before its own.
    """
    o = time_order(df, ts)
    size = F.floor(F.col("total") / (n + 1))
    at = F.col("place") - (F.col("total") - n * size)
    fold = F.when(at >= 0, F.floor(at / size) + 1)
    return df.join(o.select(ts, fold.cast("int").alias("fold")), ts)


def fold_report(folded: DataFrame, n: int = 5, ts: str = "ts") -> DataFrame:
    """Per fold: train and validation rows and their times; leaks if validation does not begin after training ends."""
    b = folded.groupBy(F.coalesce("fold", F.lit(0)).alias("fold")).agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("val_start"), F.max(ts).alias("val_end"))
    w = W.orderBy("fold").rowsBetween(W.unboundedPreceding, -1)  # n + 1 rows
    b = b.withColumns({"train_rows": F.sum("rows").over(w), "train_end": F.max("val_end").over(w)}).where("fold > 0")
    return b.select("fold", "train_rows", F.col("rows").alias("val_rows"), "train_end", "val_start", "val_end", (F.col("val_start") <= F.col("train_end")).alias("leaks"))


def holdout(df: DataFrame, days: int = 7, ts: str = "ts") -> DataFrame:
    """df with holdout: whether a row is in the last days of all."""
    end = df.agg(F.max(ts).alias("_end"))
    return df.join(F.broadcast(end)).withColumn("holdout", F.col(ts) > F.col("_end") - F.make_dt_interval(F.lit(days))).drop("_end")


def share_split(df: DataFrame, share: float = 0.8, ts: str = "ts") -> DataFrame:
    """df with train: whether a row is before the time at that share of the distinct times."""
    return df.join(time_order(df, ts), ts).withColumn("train", F.col("place") < F.floor(F.col("total") * share)).drop("place", "total")


def rolling_folds(df: DataFrame, train: int, val: int, step: int, expanding: bool = False, ts: str = "ts") -> DataFrame:
    """A row per row and fold it is in, with fold and part: train on `train` times (all before if expanding), then `val` times."""
    d = df.join(time_order(df, ts), ts)
    count = F.floor((F.col("total") - train - val) / step) + 1
    d = d.withColumn("fold", F.explode(F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>"))))
    lo = F.lit(0) if expanding else F.col("fold") * step
    end = F.col("fold") * step + train
    part = F.when((F.col("place") >= lo) & (F.col("place") < end), "train").when((F.col("place") >= end) & (F.col("place") < end + val), "val")
    return d.withColumn("part", part).where("part IS NOT NULL").drop("place", "total")



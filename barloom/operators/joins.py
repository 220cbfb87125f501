"""As-of joins, alignment of panels, and features of shorter bars inside longer ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.windows import Roll, bucket_of, by_time, chunked, faded, ratio, running

By = Sequence[str]
ASSET = ("asset",)


def asof(left: DataFrame, right: DataFrame, columns: Sequence[str], by: By = ASSET, ts: str = "ts", available: str | None = None, tolerance: str | None = None, max_rows: int | None = None, forward: bool = False, bucket: str = "7 days") -> DataFrame:
    """left with the columns of the latest right row at or before it (forward: the first at or after it).

    Both sides are put in one order instead of a range join, time bucket by time bucket: the last match of the buckets
    before is carried into each, so no task holds a whole key. available: an interval after its ts from which a right
    row can be seen (a bar labelled by its start is known at its end). tolerance: the furthest a match may lie away.
    max_rows: the most left rows for which one match counts. Of right rows with equal times the last counts.
    """
    seen = F.col(ts) + F.expr(f"INTERVAL {available}") if available else F.col(ts)
    a = left.withColumns({"_side": F.lit(0 if forward else 1), "_at": F.col(ts), "_row": F.struct(*left.columns), "_hit": F.lit(None).cast(right.select(F.struct(F.col(ts), *columns)).schema[0].dataType)})
    b = right.select(*by, F.lit(1 if forward else 0).alias("_side"), seen.alias("_at"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(F.col(ts), *columns).alias("_hit"))
    both = a.select(*by, "_side", "_at", "_row", "_hit").unionByName(b)
    if max_rows is None:
        out = running(both, {"_l": (F.when(F.col("_hit").isNotNull(), F.struct("_hit", F.col("_at").alias("t"))), "last")}, by, "_at", bucket, ("_side",), forward)
    else:
        out = _counted(both, by, bucket, forward)
    out = out.withColumns({"_m": F.col("_l._hit"), "_t": F.col("_l.t")})
    if max_rows is not None:
        out = out.withColumn("_m", F.when(F.col("_left") - F.col("_l.n") <= max_rows, F.col("_m")))
    if tolerance:
        near = F.col("_t") <= F.col("_at") + F.expr(f"INTERVAL {tolerance}") if forward else F.col("_t") >= F.col("_at") - F.expr(f"INTERVAL {tolerance}")
        out = out.withColumn("_m", F.when(near, F.col("_m")))
    return out.where("_row IS NOT NULL").select("_row.*", *(F.col(f"_m.{c}").alias(c) for c in columns))


def _counted(both: DataFrame, by: By, bucket: str, forward: bool) -> DataFrame:
    """both with _left, the left rows so far, and _l: the latest _hit, its time t, and n, the left rows up to it.

    In two levels as running(), but in one walk: rows are counted within their bucket, and what the buckets before come
    to is added to both counts.
    """
    turn = (lambda c: F.col(c).desc()) if forward else F.col
    keys = [f"_k{i}" for i in range(len(by))]
    within = W.partitionBy(*by, "_b").orderBy(turn("_at"), turn("_side")).rowsBetween(W.unboundedPreceding, 0)
    held = both.withColumn("_b", bucket_of(both, "_at", bucket))
    held = held.withColumn("_in", F.sum((F.col("_side") == (0 if forward else 1)).cast("long")).over(within))
    hit = F.when(F.col("_hit").isNotNull(), F.struct("_hit", F.col("_at").alias("t"), F.col("_in").alias("n")))
    held = held.withColumn("_own", F.last(hit, ignorenulls=True).over(within))
    end = (F.min_by if forward else F.max_by)("_own", F.struct("_at", "_side")).alias("_end")
    ends = held.groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col("_b").alias("_kb")).agg(F.max("_in").alias("_n"), end)
    before = W.partitionBy(*keys).orderBy(turn("_kb")).rowsBetween(W.unboundedPreceding, -1)
    counted = lambda x: F.when(F.col(x).isNotNull(), F.struct(F.col(f"{x}._hit"), F.col(f"{x}.t"), (F.col(f"{x}.n") + F.col("_before")).alias("n")))
    ends = ends.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_carried", F.last(counted("_end"), ignorenulls=True).over(before))
    same = F.col("_b") == F.col("_kb")
    for c, k in zip(by, keys, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    return held.join(ends, same).withColumns({"_left": F.col("_in") + F.col("_before"), "_l": F.coalesce(counted("_own"), "_carried")})


def outer_fill(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], by: By = ASSET) -> DataFrame:
    """Full outer join, then nulls of the columns take the latest value before."""
    from barloom.operators.rolling import fill

    return a.join(b, list(keys), "full").transform(lambda d: fill(d, columns, by=by))


def wide(df: DataFrame, x: str, assets: Sequence[str], ts: str = "ts", key: str = "asset", complete: bool = False) -> DataFrame:
    """A column of x per asset; complete: only times that all of them have. Assets are named, so nothing is collected."""
    out = df.groupBy(ts).pivot(key, list(assets)).agg(F.first(x))
    return out.dropna(how="any", subset=list(assets)) if complete else out


def outer_panel(df: DataFrame, x: str, assets: Sequence[str], least: int | None = None, limit: int = 3, ts: str = "ts") -> DataFrame:
    """A column of x per asset for times that `least` of them have (half of them, two at least); gaps of up to `limit` such times are filled from before, other times go."""
    from barloom.operators.rolling import fill

    d = wide(df, x, assets, ts).dropna(thresh=max(2, len(assets) // 2) if least is None else least, subset=list(assets))
    return fill(d, list(assets), limit, by=()).dropna(subset=list(assets))


def common_period(df: DataFrame, by: By = ASSET, ts: str = "ts") -> DataFrame:
    """Rows from the latest start of any key to the earliest end."""
    ends = df.groupBy(*by).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b")).agg(F.max("_a").alias("_from"), F.min("_b").alias("_to"))
    # One row.
    return df.join(F.broadcast(ends), F.col(ts).between(F.col("_from"), F.col("_to"))).drop("_from", "_to")


def micro_right(df: DataFrame, every: int = 21600, by: By = ASSET) -> DataFrame:
    """Features of the bars in (end - every, end] seconds, labelled by the end: volatility, efficiency, pressure,
    drawdown from the running high, range ratio and trend consistency."""
    second = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    label = F.timestamp_add("SECOND", (F.ceil(second / every) * every).cast("int"), F.lit("1970-01-01").cast("timestamp_ntz"))
    d = df.withColumn("_b", label)
    w = W.partitionBy(*by, "_b").orderBy("ts")
    d = d.withColumns({"_d": F.col("close") - F.lag("close").over(w), "_top": F.max("high").over(w.rowsBetween(W.unboundedPreceding, 0))})
    d = d.withColumns({"_r": ratio("_d", F.col("close") - F.col("_d")), "_dd": ratio(F.col("_top") - F.col("low"), "_top")})
    g = d.groupBy(*by, "_b").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("_r").alias("_vol"), F.min_by("close", "ts").alias("_f"), F.max_by("close", "ts").alias("_l"), F.sum(F.abs("_d")).alias("_path"),
        F.sum(F.when(F.col("close") > F.col("open"), F.col("volume")).otherwise(0.0)).alias("_up"), F.sum(F.when(F.col("close") < F.col("open"), F.col("volume")).otherwise(0.0)).alias("_dn"),
        F.max("_dd").alias("_mdd"), F.max("high").alias("_hi"), F.min("low").alias("_lo"), F.avg((F.signum("_d") > 0).cast("double")).alias("_rise"),
    )
    return g.select(
        *by, F.col("_b").alias("ts"), "n", F.coalesce("_vol", F.lit(0.0)).alias("volatility"), F.coalesce(F.least(ratio(F.abs(F.col("_l") - F.col("_f")), "_path"), F.lit(1.0)), F.lit(0.0)).alias("efficiency"),
        ((F.col("_up") + 1) / (F.col("_dn") + 1)).alias("pressure"), F.coalesce("_mdd", F.lit(0.0)).alias("max_drawdown"), F.coalesce(ratio(F.col("_hi") - F.col("_lo"), "_l"), F.lit(0.0)).alias("range_ratio"),
        F.coalesce("_rise", F.lit(0.5)).alias("consistency"),
    )


def micro_floor(df: DataFrame, every: str = "6 hours", by: By = ASSET) -> DataFrame:
    """Features of the bars in a bucket labelled by its start: range to close, variation of volume, return, deviation."""
    d = df.withColumn("_b", by_time("ts", every))
    g = d.groupBy(*by, "_b").agg(
        F.max("high").alias("_h"), F.min("low").alias("_l"), F.max_by("close", "ts").alias("_c"), F.min_by("open", "ts").alias("_o"), F.avg("volume").alias("_v"), F.stddev_samp("volume").alias("_sv"), F.stddev_samp("close").alias("micro_std"),
    )
    return g.select(*by, F.col("_b").alias("ts"), ratio(F.col("_h") - F.col("_l"), "_c").alias("micro_range"), ratio("_sv", "_v").alias("micro_volume_cv"), ratio(F.col("_c") - F.col("_o"), "_o").alias("micro_return"), "micro_std")


def mtf(micro: DataFrame, macro: DataFrame, limit: int = 12, by: By = ASSET, available: str | None = None) -> DataFrame:
    """micro bars with eight features of the latest macro bar, for at most `limit` rows each, else 0."""
    from barloom.operators.indicators import adx, macd, roc, rsi, sma
    from barloom.operators.rolling import returns

    def features(m: DataFrame, by: By) -> DataFrame:
        d = adx(roc(rsi(macd(sma(returns(m, by=by), (50, 200), by=by), by=by), by=by), 21, by=by), by=by)
        return d.withColumn("_vol", Roll(by).std("log_ret", 20))

    d = chunked(macro, features, max(200, faded(26) + faded(9)), by)
    d = d.select(
        *by, "ts", F.col("rsi_14").alias("macro_rsi"), F.when(F.col("sma_50") > F.col("sma_200"), 1.0).otherwise(-1.0).alias("macro_trend"), F.col("_vol").alias("macro_vol"),
        F.col("roc_21").alias("macro_roc"), F.col("adx_14").alias("macro_adx"), F.col("macd").alias("macro_macd"), F.col("macd_hist").alias("macro_macd_hist"), ratio(F.col("close") - F.col("sma_50"), "sma_50").alias("macro_dist"),
    )
    names = [c for c in d.columns if c.startswith("macro_")]
    out = asof(micro, d, names, by, available=available, max_rows=limit)
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in names})


def first_hour_bars(signals: DataFrame, bars: DataFrame, every: str = "1 hour", by: By = ASSET) -> DataFrame:
    """Bars inside the bucket that begins with each signal's time: an equality join on the bucket, not a range join."""
    return signals.withColumnRenamed("ts", "signal_ts").withColumn("_b", by_time("signal_ts", every)).join(bars.withColumn("_b", by_time("ts", every)), [*by, "_b"]).drop("_b")


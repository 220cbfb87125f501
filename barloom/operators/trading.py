"""Signals, entries, sizing and backtests. Equity compounds by products of net returns, so no row waits for the one before."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.quantiles import exact
from barloom.functions.windows import Roll, bounded, by_time, ratio, running

By = Sequence[str]
ASSET = ("asset",)


def forced_entry(df: DataFrame, p: str = "p", signal: str = "signal", by: By = ASSET) -> DataFrame:
    """Of each day without a signal of 1 the row with the highest probability (of equal ones the first) is forced."""
    day = W.partitionBy(*by, F.to_date("ts"))
    best = F.row_number().over(day.orderBy(F.col(p).desc(), "ts"))
    d = df.withColumns({"_any": F.max((F.col(signal) == 1).cast("int")).over(day), "_best": best})
    d = d.withColumn("forced", (F.col("_any") == 0) & (F.col("_best") == 1))
    return d.withColumn("final_signal", F.when(F.col("forced"), 1).otherwise(F.col(signal))).drop("_any", "_best")


def forced_performance(df: DataFrame, ret: str = "fwd_ret") -> DataFrame:
    """Mean return, win rate and rows of forced and of all other rows."""
    return df.where(F.col(ret).isNotNull()).groupBy("forced").agg(F.count(F.lit(1)).alias("n"), F.avg(ret).alias("mean_return"), F.avg((F.col(ret) > 0).cast("double")).alias("win_rate"))


def risk_multiplier(df: DataFrame, mode: str = "moderate", warning: str = "warning", z: str = "z_acf", lo: float = 1.0, hi: float = 3.0) -> DataFrame:
    """Position size in 0..1: strict stops on a warning, moderate halves, continuous falls from 1 at z = lo to 0 at hi."""
    if mode == "continuous":
        size = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(hi) - F.coalesce(F.col(z), F.lit(lo))) / (hi - lo)))
    else:
        size = F.when(F.col(warning), 0.0 if mode == "strict" else 0.5).otherwise(1.0)
    return df.withColumn("size", size)


def trade_policy(df: DataFrame, table: dict[str, tuple[float, float, float]], regime: str = "regime") -> DataFrame:
    """tp, sl and leverage of a row's regime: table has (tp, sl, risk factor); leverage is 1 % * factor / sl, in 1..10, to two places; Stress has 1."""
    pick = lambda k: F.coalesce(*(F.when(F.col(regime) == r, v[k]) for r, v in table.items()))
    d = df.withColumns({"tp": pick(0), "sl": pick(1), "_f": pick(2)})
    lev = F.round(F.greatest(F.lit(1.0), F.least(F.lit(10.0), 0.01 * F.col("_f") / F.col("sl"))), 2)
    return d.withColumn("leverage", F.when(F.col(regime) == "Stress", 1.0).otherwise(lev)).drop("_f")


@bounded(lambda a: max(a["fast"], a["slow"]))
def sma_cross(df: DataFrame, fast: int = 50, slow: int = 200, by: By = ASSET) -> DataFrame:
    r = Roll(by)
    d = df.withColumns({"_f": r.mean("close", fast), "_s": r.mean("close", slow)})
    return d.withColumn("signal", F.when(F.col("_f") > F.col("_s"), 1).when(F.col("_f") < F.col("_s"), -1).otherwise(0)).drop("_f", "_s")


def confluence(df: DataFrame, *states: str, bull: str = "Bull", bear: str = "Bear") -> DataFrame:
    """1 if all states are bull, -1 if all are bear, else 0."""
    both = lambda v: [F.col(s) == v for s in states]
    all_ = lambda cs: reduce(lambda a, b: a & b, cs)
    return df.withColumn("signal", F.when(all_(both(bull)), 1).when(all_(both(bear)), -1).otherwise(0))


@bounded(lambda a: 2)
def _net(df: DataFrame, signal: str, fee: float, by: By = ASSET) -> DataFrame:
    """df with net: what the signal of the bar before earns, less a fee per unit of change."""
    r = Roll(by)
    d = df.withColumns({"_pos": F.coalesce(r.lag(signal), F.lit(0)), "_ret": F.coalesce(F.ln(F.col("close") / r.lag("close")), F.lit(0.0))})
    return d.withColumn("net", F.col("_pos") * F.col("_ret") - fee * F.abs(F.col("_pos") - F.coalesce(r.lag("_pos"), F.lit(0)))).drop("_pos", "_ret")


def vector_backtest(df: DataFrame, signal: str = "signal", fee: float = 0.0006, by: By = ASSET) -> DataFrame:
    """net, equity and drawdown of the signal one bar later, with a fee per unit of change."""
    d = running(_net(df, signal, fee, by=by), {"_sum": (F.col("net"), "sum"), "_top": (F.col("net"), "peak")}, by)
    return d.withColumns({"equity": F.exp("_sum"), "drawdown": F.exp(F.col("_sum") - F.col("_top")) - 1}).drop("_sum", "_top")


def performance(df: DataFrame, periods: float = 24 * 365, by: By = ASSET) -> DataFrame:
    """Total return, Sharpe ratio of the year and largest drawdown of a backtest."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.max_by("equity", "ts") - 1).alias("total_return"),
        F.coalesce(ratio(F.avg("net"), F.when(F.stddev_samp("net") > 1e-12, F.stddev_samp("net"))) * periods**0.5, F.lit(0.0)).alias("sharpe"), F.min("drawdown").alias("max_drawdown"),
    )


def sniper_entries(signals: DataFrame, bars: DataFrame, z: str = "z", limit: float = 1.5, every: str = "6 hours", strict_last: int | None = None, by: By = ASSET) -> DataFrame:
    """Per signal (side +-1) the first bar of its bucket whose z is beyond the limit against the side; else no row.

    z comes from the whole history of bars, then is restricted to the bucket. strict_last: seconds into the bucket from
    which no entry is taken.
    """
    s = signals.where("side <> 0").withColumnRenamed("ts", "signal_ts").select(*by, "signal_ts", "side", by_time("signal_ts", every).alias("_b"))
    b = bars.select(*by, F.col("ts").alias("bar_ts"), F.col("close").alias("bar_close"), F.col(z).alias("_z"), by_time("ts", every).alias("_b"))
    ok = F.when(F.col("side") == 1, F.col("_z") <= -limit).otherwise(F.col("_z") >= limit)
    if strict_last is not None:
        ok = ok & (F.timestamp_diff("SECOND", F.col("_b"), F.col("bar_ts")) < strict_last)
    return s.join(b, [*by, "_b"]).where(ok).groupBy(*by, "signal_ts", "side").agg(F.min("bar_ts").alias("entry_ts"), F.min_by("bar_close", "bar_ts").alias("entry_price"), F.min_by("_z", "bar_ts").alias("entry_z"))


def trade_returns(trades: DataFrame, fee: float = 0.0006, slippage: float = 0.0002, size: float = 0.1, leverage: float = 1.0, start: float = 10_000.0, by: By = ASSET, ts: str = "entry_ts") -> DataFrame:
    """net (after slippage and fees on both sides), equity after each trade, drawdown and ruined; trades: side, entry_price, exit_price.

    A trade that loses all that the account has, or more, ruins it: equity is 0 from there on. A trade at a price of 0 has
    no net and changes nothing.
    """
    paid = F.col("entry_price") * (1 + F.col("side") * slippage)
    got = F.col("exit_price") * (1 - F.col("side") * slippage)
    d = trades.withColumn("net", F.col("side") * (ratio(got, paid) - 1) - 2 * fee)
    # A product as a sum of logarithms, as long as each step's factor is positive.
    left = 1 + size * leverage * F.col("net")
    step = F.coalesce(F.when(left > 0, F.ln(left)), F.lit(0.0))
    d = running(d, {"_sum": (step, "sum"), "_top": (step, "peak"), "_ruin": (F.coalesce(left <= 0, F.lit(False)).cast("int"), "max")}, by, ts, "7 days")
    ruined = F.col("_ruin") == 1
    d = d.withColumns({
        "equity": F.when(ruined, 0.0).otherwise(start * F.exp("_sum")), "drawdown": F.when(ruined, -1.0).otherwise(F.exp(F.col("_sum") - F.greatest(F.lit(0.0), "_top")) - 1), "ruined": ruined,
    })
    return d.drop("_sum", "_top", "_ruin")


def trade_statistics(trades: DataFrame, start: float = 10_000.0, by: By = ASSET, ts: str = "entry_ts") -> DataFrame:
    sd = F.stddev_samp("net")
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.max_by("equity", ts) / start - 1).alias("total_return"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"), F.min("drawdown").alias("max_drawdown"),
        F.coalesce(ratio(F.avg("net"), F.when(sd > 1e-12, sd)) * F.sqrt(F.count(F.lit(1))), F.lit(0.0)).alias("sharpe"),
    )


def entry_improvement(a: DataFrame, b: DataFrame, by: By = ASSET) -> DataFrame:
    """How much better a's entries are than b's of the same signal, in basis points: mean, median and share better."""
    d = a.select(*by, "signal_ts", "side", F.col("entry_price").alias("_a")).join(b.select(*by, "signal_ts", F.col("entry_price").alias("_b")), [*by, "signal_ts"])
    d = d.withColumn("_bps", F.col("side") * ratio(F.col("_b") - F.col("_a"), "_b") * 10_000)
    middle = exact(d, ["_bps"], [0.5], by).select(*(F.col(k).alias(f"_k_{k}") for k in by), F.col("values")[0].alias("median_bps"))
    sums = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_bps").alias("mean_bps"), F.avg((F.col("_bps") > 0).cast("double")).alias("better"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by))
    return sums.join(middle, same).select(*by, "n", "mean_bps", "median_bps", "better")


def strategies(a: DataFrame, b: DataFrame, by: By = ASSET) -> DataFrame:
    """Statistics of two strategies beside each other, best improvement first."""
    c = ("total_return", "sharpe", "max_drawdown")
    d = a.select(*by, *(F.col(x).alias(f"{x}_a") for x in c)).join(b.select(*by, *(F.col(x).alias(f"{x}_b") for x in c)), list(by))
    d = d.withColumns({f"{x}_gain": F.col(f"{x}_b") - F.col(f"{x}_a") for x in c})
    return d.withColumn("return_to_drawdown", ratio("total_return_b", F.abs("max_drawdown_b"))).orderBy(F.col("total_return_gain").desc(), *by)


def hysteresis(df: DataFrame, x: str = "rsi_14", buy: float = 30, sell: float = 50, by: By = ASSET) -> DataFrame:
    """position 1 from x < buy until x > sell: the latest of these events holds. accounts.guarded() adds the cash."""
    event = F.when(F.col(x) < buy, 1).when(F.col(x) > sell, 0)
    return running(df, {"_e": (event, "last")}, by).withColumn("position", F.coalesce("_e", F.lit(0))).drop("_e")


def barrier_simulation(labelled: DataFrame, tp: float, sl: float, size: float = 0.1, leverage: Column | float = 1.0, start: float = 10_000.0, by: By = ASSET) -> DataFrame:
    """Balance over labelled entries (1: tp gained, 0: sl lost), each compounding in order of entry."""
    lev = F.lit(float(leverage)) if isinstance(leverage, (int, float)) else leverage
    d = labelled.where("label IS NOT NULL").withColumn("pnl", size * lev * F.when(F.col("label") == 1, tp).otherwise(-sl))
    return running(d, {"_sum": (F.log1p("pnl"), "sum")}, by).withColumn("balance", start * F.exp("_sum")).drop("_sum")


@bounded(ahead=lambda a: 2)
def _next_bars(bars: DataFrame, by: By = ASSET) -> DataFrame:
    r = Roll(by)
    return bars.withColumns({"_ts": r.lead("ts"), "_o": r.lead("open"), "_c": r.lead("close"), "_ts2": r.lead("ts", 2), "_o2": r.lead("open", 2)})


def confirmation(signals: DataFrame, bars: DataFrame, by: By = ASSET) -> DataFrame:
    """Entry at the first bar after a signal if it closes in the signal's direction (A), else at the next one (B)."""
    d = signals.join(_next_bars(bars, by=by).select(*by, "ts", "_ts", "_o", "_c", "_ts2", "_o2"), [*by, "ts"]).where("side <> 0")
    yes = F.signum(F.col("_c") - F.col("_o")) == F.col("side")
    return d.select(*by, "ts", "side", F.when(yes, "A").otherwise("B").alias("scenario"), F.when(yes, F.col("_ts")).otherwise(F.col("_ts2")).alias("entry_ts"), F.when(yes, F.col("_c")).otherwise(F.col("_o2")).alias("entry_price")).where("entry_ts IS NOT NULL")

"""Technical indicators over bars. Averages are simple ones throughout; a rolling value is null until its window is full.

Each works in chunks of a history, of which the lambda above it says how many rows it looks back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import EPS, Roll, bounded, ema, faded, ratio, running_sum

By = Sequence[str]
ASSET = ("asset",)


@bounded(lambda a: a["n"] + 1)
def rsi(df: DataFrame, n: int = 14, price: str = "close", name: str | None = None, by: By = ASSET) -> DataFrame:
    r = Roll(by)
    d = df.withColumn("_d", F.col(price) - r.lag(price)).withColumns({"_g": F.coalesce(F.greatest("_d", F.lit(0.0)), F.lit(0.0)), "_l": F.coalesce(F.greatest(-F.col("_d"), F.lit(0.0)), F.lit(0.0))})
    rs = r.mean("_g", n) / (r.mean("_l", n) + EPS)
    return d.withColumn(name or f"rsi_{n}", 100 - 100 / (1 + rs)).drop("_d", "_g", "_l")


@bounded(lambda a: max(a["windows"]))
def sma(df: DataFrame, windows: Sequence[int] = (20,), price: str = "close", by: By = ASSET) -> DataFrame:
    return df.withColumns({f"sma_{n}": Roll(by).mean(price, n) for n in windows})


@bounded(lambda a: faded(max(a["fast"], a["slow"])) + faded(a["signal"]))
def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, price: str = "close", by: By = ASSET) -> DataFrame:
    d = ema(df, {"_fast": (price, fast), "_slow": (price, slow)}, by).withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return ema(d, {"macd_signal": ("macd", signal)}, by).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


@bounded(lambda a: a["n"])
def bbands(df: DataFrame, n: int = 20, k: float = 2.0, price: str = "close", by: By = ASSET) -> DataFrame:
    r = Roll(by)
    d = df.withColumns({"bb_mid": r.mean(price, n), "_s": r.std(price, n)})
    d = d.withColumns({"bb_upper": F.col("bb_mid") + k * F.col("_s"), "bb_lower": F.col("bb_mid") - k * F.col("_s")})
    span = F.col("bb_upper") - F.col("bb_lower")
    return d.withColumns({"bb_width": ratio(span, "bb_mid"), "bb_pct": (F.col(price) - F.col("bb_lower")) / (span + EPS)}).drop("_s")


@bounded(lambda a: 1)
def true_range(df: DataFrame, by: By = ASSET, name: str = "tr") -> DataFrame:
    before = Roll(by).lag("close")
    return df.withColumn(name, F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


@bounded(lambda a: a["n"] + 1)
def atr(df: DataFrame, n: int = 14, by: By = ASSET) -> DataFrame:
    """atr_n, and natr_n as a percentage of the close."""
    d = true_range(df, by, "_tr").withColumn(f"atr_{n}", Roll(by).mean("_tr", n))
    return d.withColumn(f"natr_{n}", 100 * ratio(f"atr_{n}", "close")).drop("_tr")


@bounded(lambda a: a["n"])
def roc(df: DataFrame, n: int = 10, price: str = "close", by: By = ASSET) -> DataFrame:
    before = Roll(by).lag(price, n)
    return df.withColumn(f"roc_{n}", 100 * ratio(F.col(price) - before, before))


def typical() -> "F.Column":
    return (F.col("high") + F.col("low") + F.col("close")) / 3


@bounded(lambda a: a["n"])
def cci(df: DataFrame, n: int = 20, k: float = 0.015, by: By = ASSET) -> DataFrame:
    """The mean deviation is about each window's own mean, so the window is an array of n values."""
    r = Roll(by)
    d = df.withColumn("_tp", typical()).withColumns({"_m": r.mean("_tp", n), "_a": F.collect_list("_tp").over(r.frame(n))})
    mad = F.aggregate("_a", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("_m"))) / n
    return d.withColumn(f"cci_{n}", (F.col("_tp") - F.col("_m")) / (k * mad + EPS)).drop("_tp", "_m", "_a")


@bounded(lambda a: a["n"])
def willr(df: DataFrame, n: int = 14, by: By = ASSET) -> DataFrame:
    r = Roll(by)
    hh, ll = r.max("high", n), r.min("low", n)
    return df.withColumn(f"willr_{n}", -100 * (hh - F.col("close")) / (hh - ll + EPS))


@bounded(lambda a: 2 * a["n"] + 1)
def adx(df: DataFrame, n: int = 14, by: By = ASSET) -> DataFrame:
    r = Roll(by)
    d = true_range(df, by, "_tr").withColumns({"_up": F.col("high") - r.lag("high"), "_dn": r.lag("low") - F.col("low")})
    d = d.withColumns({
        "_p": F.when((F.col("_up") > F.col("_dn")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0),
        "_m": F.when((F.col("_dn") > F.col("_up")) & (F.col("_dn") > 0), F.col("_dn")).otherwise(0.0),
    })
    d = d.withColumns({"_atr": r.mean("_tr", n), "_pa": r.mean("_p", n), "_ma": r.mean("_m", n)})
    d = d.withColumns({"plus_di": 100 * F.col("_pa") / (F.col("_atr") + EPS), "minus_di": 100 * F.col("_ma") / (F.col("_atr") + EPS)})
    d = d.withColumn("_dx", 100 * F.abs(F.col("plus_di") - F.col("minus_di")) / (F.col("plus_di") + F.col("minus_di") + EPS))
    return d.withColumn(f"adx_{n}", r.mean("_dx", n)).drop("_tr", "_up", "_dn", "_p", "_m", "_atr", "_pa", "_ma", "_dx")


@bounded(lambda a: 1)
def _signed_volume(df: DataFrame, by: By = ASSET) -> DataFrame:
    return df.withColumn("_d", F.coalesce(F.signum(F.col("close") - Roll(by).lag("close")) * F.col("volume"), F.lit(0.0)))


def obv(df: DataFrame, by: By = ASSET, every: str = "1 day") -> DataFrame:
    """A running sum of signed volume, worked out in time buckets."""
    return running_sum(_signed_volume(df, by=by), F.col("_d"), "obv", by, every=every).drop("_d")


@bounded(lambda a: a["n"])
def cmf(df: DataFrame, n: int = 20, by: By = ASSET) -> DataFrame:
    r = Roll(by)
    mfm = (2 * F.col("close") - F.col("low") - F.col("high")) / (F.col("high") - F.col("low") + EPS)
    d = df.withColumn("_v", mfm * F.col("volume"))
    return d.withColumn(f"cmf_{n}", r.sum("_v", n) / (r.sum("volume", n) + EPS)).drop("_v")


@bounded(lambda a: a["n"] + 1)
def mfi(df: DataFrame, n: int = 14, by: By = ASSET) -> DataFrame:
    r = Roll(by)
    d = df.withColumn("_tp", typical()).withColumn("_b", r.lag("_tp"))
    flow = F.col("_tp") * F.col("volume")
    d = d.withColumns({"_up": F.when(F.col("_tp") > F.col("_b"), flow).otherwise(0.0), "_dn": F.when(F.col("_tp") < F.col("_b"), flow).otherwise(0.0)})
    d = d.withColumn(f"mfi_{n}", 100 - 100 / (1 + r.sum("_up", n) / (r.sum("_dn", n) + EPS)))
    return d.drop("_tp", "_b", "_up", "_dn")


@bounded(lambda a: a["n"])
def slope(df: DataFrame, n: int = 14, price: str = "close", by: By = ASSET) -> DataFrame:
    """Least-squares slope over 0..n-1: a sum of the last n values weighed by their place about the middle."""
    r = Roll(by)
    d = df.withColumn("_n", r.number().cast("double"))
    w = r.frame(n)
    s = F.covar_pop(F.col("_n"), F.col(price)).over(w) / ((n * n - 1) / 12)
    return d.withColumn(f"slope_{n}", F.when(F.count(price).over(w) >= n, s)).drop("_n")


@bounded(lambda a: max(a["fast"], a["slow"]))
def ao(df: DataFrame, fast: int = 5, slow: int = 34, by: By = ASSET) -> DataFrame:
    d = df.withColumn("_m", (F.col("high") + F.col("low")) / 2)
    return d.withColumn("ao", Roll(by).mean("_m", fast) - Roll(by).mean("_m", slow)).drop("_m")


@bounded(lambda a: a["n"] + a["k"] + a["d"])
def stoch(df: DataFrame, n: int = 14, k: int = 3, d: int = 3, by: By = ASSET) -> DataFrame:
    r = Roll(by)
    hh, ll = r.max("high", n), r.min("low", n)
    out = df.withColumn("_raw", 100 * (F.col("close") - ll) / (hh - ll + EPS)).withColumn("stoch_k", r.mean("_raw", k))
    return out.withColumn("stoch_d", r.mean("stoch_k", d)).drop("_raw")


@bounded(lambda a: max(a["low"], a["high"]))
def donchian(df: DataFrame, low: int = 20, high: int = 20, by: By = ASSET) -> DataFrame:
    r = Roll(by)
    d = df.withColumns({"dc_low": r.min("low", low), "dc_high": r.max("high", high)})
    return d.withColumn("dc_mid", (F.col("dc_low") + F.col("dc_high")) / 2)


@bounded(lambda a: faded(a["n"]))
def dist_ema(df: DataFrame, n: int = 20, price: str = "close", by: By = ASSET) -> DataFrame:
    d = ema(df, {f"ema_{n}": (price, n)}, by)
    return d.withColumn(f"dist_ema_{n}", ratio(F.col(price) - F.col(f"ema_{n}"), f"ema_{n}"))

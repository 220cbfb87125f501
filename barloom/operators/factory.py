"""The feature factory: indicators over many windows, statistics, physics, lags, then rows without gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import Roll, chunked, faded, ratio, running_sum
from barloom.operators import indicators as I
from barloom.operators import rolling

WINDOWS = (3, 5, 8, 13, 14, 21, 34, 55, 89, 144, 200)
STATS = (20, 24, 50, 100)


def signals(df: DataFrame, windows: Sequence[int] = WINDOWS, stats: Sequence[int] = STATS, lag: Sequence[int] = (1, 2, 3, 5, 8, 13), warmup: int = 200, by: Sequence[str] = ("asset",)) -> DataFrame:
    """bars with the whole feature set and each feature's lags; the first `warmup` rows and rows with nulls are left out.

    Frames of all windows on one base column are one Window node, and all lags are one more, in shared chunks.
    """
    numbered = running_sum(df, F.lit(1), "_n", by)
    back = max(*windows, *stats, 48 + 168, faded(26) + faded(9)) + max(lag) + 2
    return chunked(numbered, lambda d, keys: _signals(d, windows, stats, lag, warmup, keys), back, by).drop("_n")


def _signals(df: DataFrame, windows: Sequence[int], stats: Sequence[int], lag: Sequence[int], warmup: int, by: Sequence[str]) -> DataFrame:
    r = Roll(by)
    d = rolling.candle(rolling.returns(df, by=by))
    d = d.withColumns({"_g": F.coalesce(F.greatest("diff", F.lit(0.0)), F.lit(0.0)), "_l": F.coalesce(F.greatest(-F.col("diff"), F.lit(0.0)), F.lit(0.0)), "_mid": (F.col("high") + F.col("low")) / 2})
    d = I.true_range(d, by, "_tr")
    cols = {}
    for n in windows:
        mean, hh, ll = r.mean("close", n), r.max("high", n), r.min("low", n)
        cols |= {
            f"rsi_{n}": 100 - 100 / (1 + r.mean("_g", n) / (r.mean("_l", n) + 1e-10)), f"dist_sma_{n}": ratio(F.col("close") - mean, mean), f"atr_{n}": r.mean("_tr", n), f"natr_{n}": 100 * ratio(r.mean("_tr", n), "close"),
            f"roc_{n}": 100 * ratio(F.col("close") - r.lag("close", n), r.lag("close", n)), f"willr_{n}": -100 * (hh - F.col("close")) / (hh - ll + 1e-10), f"bb_width_{n}": ratio(4 * r.std("close", n), mean),
            f"dc_width_{n}": ratio(hh - ll, "close"), f"volume_ratio_{n}": ratio("volume", r.mean("volume", n)),
        }
    for n in stats:
        cols |= {f"vol_{n}": r.std("log_ret", n), f"z_{n}": ratio(F.col("close") - r.mean("close", n), r.std("close", n))}
    cols["ao"] = r.mean("_mid", 5) - r.mean("_mid", 34)
    d = d.withColumns(cols).drop("_g", "_l", "_mid", "_tr")
    d = I.macd(rolling.fdi(rolling.stability(d, window=48, span=168, by=by), by=by), by=by)
    features = [c for c, t in d.dtypes if t == "double" and c not in ("open", "high", "low", "close", "volume")]
    d = d.withColumns({f"{c}_lag_{k}": r.lag(c, k) for c in features for k in lag})
    return d.where(F.col("_n") > warmup).dropna(subset=[c for c in d.columns if not c.startswith("_")])


def dashboard(df: DataFrame, by: Sequence[str] = ("asset",)) -> DataFrame:
    """The features of the model dashboard: oscillators, channel width, volume flow, lags of returns, parts of the date."""
    return chunked(I.obv(df, by), lambda d, keys: _dashboard(d, keys), 60, by)


def _dashboard(df: DataFrame, by: Sequence[str]) -> DataFrame:
    r = Roll(by)
    d = I.donchian(I.stoch(I.ao(rolling.returns(df, by=by), by=by), by=by), by=by)
    d = d.withColumns({"sma_50": r.mean("close", 50), "_obv_50": r.mean("obv", 50), "_v20": r.mean("volume", 20)})
    return d.withColumns({
        "dc_width": ratio(F.col("dc_high") - F.col("dc_low"), "close"), "obv_ratio": ratio("obv", "_obv_50"), "volume_ratio": ratio("volume", "_v20"), "sma_50_slope": ratio(F.col("sma_50") - r.lag("sma_50", 5), r.lag("sma_50", 5)),
        **{f"ret_lag_{k}": r.lag("pct_ret", k) for k in (1, 2, 3)}, "hour": F.hour("ts"), "weekday": F.weekday("ts"), "hl_ratio": ratio("high", "low"), "close_position": ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low")),
    }).drop("_obv_50", "_v20")

"""What kind of process each asset's prices are: five rolling metrics, their distributions, a verdict on each, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import Roll, bounded, chunked, ratio
from barloom.operators import physics, rolling

By = Sequence[str]
ASSET = ("asset",)
METRICS = ["hurst", "theta", "entropy", "fracdiff_corr", "vol_of_vol"]
#: Fixed values. A metric's mean above a limit has that verdict, the first that holds; else the last one.
VERDICTS = {
    "hurst": [(0.55, "TRENDING"), (0.45, "RANDOM WALK"), (None, "MEAN-REVERTING")],
    "theta": [(0.1, "ELASTIC"), (0.01, "MODERATE"), (None, "WEAK REVERSION")],
    "entropy": [(2.5, "HIGH NOISE"), (1.5, "MODERATE NOISE"), (None, "LOW NOISE")],
    "fracdiff_corr": [(0.7, "STRONG MEMORY"), (0.3, "MODERATE MEMORY"), (None, "WEAK MEMORY")],
    "vol_of_vol": [(1.0, "EXPLOSIVE"), (None, "STABLE")],
}


@bounded(lambda a: a["n"])
def _likeness(df: DataFrame, a: str, b: str, n: int, name: str, by: By = ASSET) -> DataFrame:
    """df with the correlation of a and b over the last n rows, null unless all have both."""
    frame = Roll(by).frame(n)
    pair = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)
    one, two = pair * F.col(a), pair * F.col(b)
    value = F.try_divide(F.covar_pop(one, two).over(frame), F.stddev_pop(one).over(frame) * F.stddev_pop(two).over(frame))
    return df.withColumn(name, F.when(F.count(pair).over(frame) >= n, value))


def metrics(bars: DataFrame, hurst: int = 100, theta: int = 100, entropy: int = 100, fracdiff: int = 100, vol: int = 24, d: float = 0.5, orders: DataFrame | None = None, by: By = ASSET) -> DataFrame:
    """bars with hurst, theta, entropy of returns, correlation with the fractional difference, and volatility of volatility.

    d: the order of that difference; orders: one for each key (by, d), as find_min_d() gives it.
    """
    m = physics.frac_diff(bars, d, name="close_fd", by=by, cut=1e-3) if orders is None else physics.frac_diff_panel(bars, orders, ["close"], by=by)

    def work(c: DataFrame, keys: By) -> DataFrame:
        c = rolling.returns(rolling.hurst(c, hurst, by=keys, name="hurst"), by=keys)
        c = rolling.stability(c, window=theta, span=theta, by=keys, current=False)
        c = rolling.entropy(c, entropy, "pct_ret", by=keys).withColumnRenamed(f"entropy_{entropy}", "entropy")
        c = _likeness(c, "close", "close_fd", fracdiff, "fracdiff_corr", by=keys)
        return rolling.vol_of_vol(c, "pct_ret", vol, by=keys)

    # The five look back side by side, so they share one pass in chunks.
    return chunked(m, work, max(hurst + 1, 2 * theta + 2, entropy + 1, fracdiff, 2 * vol + 1), by).select(*bars.columns, *METRICS)


def summary(measured: DataFrame, by: By = ASSET) -> DataFrame:
    """A row per key and metric: n, mean, std, least, quartiles, most."""
    return rolling.profile(measured, METRICS, by)


def _verdict(metric: str) -> Column:
    x = ratio("std", F.when(F.col("mean") > 0, F.col("mean"))) if metric == "vol_of_vol" else F.col("mean")
    out = None
    for limit, words in VERDICTS[metric]:
        rule = F.lit(words) if limit is None else F.when(x >= limit if words == "RANDOM WALK" else x > limit, words)
        out = rule if out is None else F.coalesce(out, rule)
    return F.when(F.col("metric") == metric, F.when(F.col("n") > 0, out))


def diagnose(profiles: DataFrame) -> DataFrame:
    """profiles (of summary()) with verdict: what the mean says of the metric, or, of volatility, its deviation over its mean. Null without values."""
    return profiles.withColumn("verdict", F.coalesce(*(_verdict(m) for m in VERDICTS)))


def compare_all(profiles: DataFrame, key: str = "asset") -> DataFrame:
    """metric, asset_a, asset_b, mean_a, mean_b, difference, percent (of b's mean) for each pair of keys, a before b."""
    side = lambda s: profiles.select("metric", F.col(key).alias(f"asset_{s}"), F.col("mean").alias(f"mean_{s}"))
    both = side("a").join(side("b"), "metric").where("asset_a < asset_b")
    away = F.col("mean_a") - F.col("mean_b")
    return both.withColumns({"difference": away, "percent": 100 * ratio(away, "mean_b")})

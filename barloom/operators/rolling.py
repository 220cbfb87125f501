"""Returns, candle shapes, rolling moments, regime statistics of prices (stability, fractal dimension, Hurst, entropy)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.quantiles import exact
from barloom.functions.windows import EPS, Roll, bounded, clip, ratio, running

By = Sequence[str]
ASSET = ("asset",)


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b), null unless both are positive."""
    return F.when((a > 0) & (b > 0), F.ln(a / b))


def log_ratio_limits(a: Column, b: Column) -> Column:
    """ln(a / b) of any two numbers by IEEE 754: inf of a positive over zero, -inf of zero, NaN of a negative or of zero over zero."""
    q = F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)
    return F.when(q < 0, F.lit(float("nan"))).when(q == 0, F.lit(float("-inf"))).otherwise(F.ln(q))


@bounded(lambda a: 1)
def returns(df: DataFrame, price: str = "close", by: By = ASSET, limits: bool = False) -> DataFrame:
    """Changes of a price and the log range of a bar. Logarithms are null unless both prices are positive, or with `limits`
    what IEEE 754 gives (an hour whose low is 0 has a log range of inf)."""
    before, log = Roll(by).lag(price), log_ratio_limits if limits else log_ratio
    return df.withColumns({"log_ret": log(F.col(price), before), "pct_ret": ratio(F.col(price) - before, before), "diff": F.col(price) - before, "log_range": log(F.col("high"), F.col("low"))})


def candle(df: DataFrame, eps: float = 1e-9) -> DataFrame:
    span = F.col("high") - F.col("low") + eps
    return df.withColumns({
        "body_ratio": F.abs(F.col("close") - F.col("open")) / span, "upper_shadow": (F.col("high") - F.greatest("open", "close")) / span,
        "lower_shadow": (F.least("open", "close") - F.col("low")) / span,
    })


@bounded(lambda a: max(a["steps"]))
def lags(df: DataFrame, columns: Sequence[str], steps: Sequence[int] = (1, 2, 3, 5, 8, 13), by: By = ASSET) -> DataFrame:
    """Every column at every lag; all of them are one Window node."""
    r = Roll(by)
    return df.withColumns({f"{c}_lag_{k}": r.lag(c, k) for c in columns for k in steps})


@bounded(lambda a: a["n"])
def moments(df: DataFrame, x: str = "log_ret", n: int = 20, by: By = ASSET, name: str | None = None) -> DataFrame:
    """Rolling standard deviation, skewness and excess kurtosis, corrected for bias."""
    r, p = Roll(by), name or x
    d = df.withColumns({"_sd": r.std(x, n), "_vp": r.agg(x, n, F.var_pop)})
    ok = F.col("_vp") > 1e-18
    d = d.withColumns({"_c": F.collect_list(x).over(r.frame(n)), "_m": r.mean(x, n)})
    power = lambda k: F.aggregate("_c", F.lit(0.0), lambda s, v: s + F.pow(v - F.col("_m"), F.lit(float(k)))) / n
    g1, g2 = power(3) / F.pow("_vp", F.lit(1.5)), power(4) / (F.col("_vp") * F.col("_vp")) - 3
    return d.withColumns({
        f"{p}_std": F.col("_sd"), f"{p}_skew": F.when(ok, g1 * (n * (n - 1)) ** 0.5 / (n - 2)),
        f"{p}_kurt": F.when(ok, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))),
    }).drop("_sd", "_vp", "_c", "_m")


@bounded(lambda a: a["n"])
def zscore(df: DataFrame, x: str = "close", n: int = 20, eps: float = 0.0, by: By = ASSET, name: str | None = None) -> DataFrame:
    r = Roll(by)
    return df.withColumn(name or f"z_{n}", ratio(F.col(x) - r.mean(x, n), r.std(x, n) + eps))


def _autoregression(x: str, before: str, frame, n: int, min_n: int) -> tuple[Column, Column]:
    """Correlation and slope of x on its predecessor over a frame; null where either does not vary."""
    cov, vb = F.covar_pop(F.col(x), F.col(before)).over(frame), F.var_pop(before).over(frame)
    vx = F.var_pop(F.when(F.col(before).isNotNull(), F.col(x))).over(frame)
    full = F.count(before).over(frame) >= min_n
    return F.when(full & (vx > EPS**2) & (vb > EPS**2), cov / F.sqrt(vx * vb)), F.when(full & (vb > EPS**2), cov / vb)


@bounded(lambda a: a["window"] + a["span"] + 2)
def stability(df: DataFrame, x: str = "close", window: int = 168, span: int = 504, limit: float = 2.0, by: By = ASSET, current: bool = True) -> DataFrame:
    """Autocorrelation and speed of mean reversion (-ln of the AR(1) slope in (0, 1), else 0), their z-scores over
    `span` (from `window` values on) and a warning when memory grows or reversion slows by `limit` deviations.

    current=False leaves the row itself out of its window.
    """
    r = Roll(by)
    d = df.withColumn("_b", r.lag(x))
    acf, beta = _autoregression(x, "_b", r.frame(window, 0 if current else -1), window, window - 1 if not current else window)
    d = d.withColumns({"acf": acf, "_beta": beta})
    d = d.withColumn("theta", F.when(F.col("_beta").isNull(), None).when((F.col("_beta") > 0) & (F.col("_beta") < 1), -F.ln("_beta")).otherwise(0.0))
    z = lambda c: ratio(F.col(c) - r.mean(c, span, least=window), F.when(r.std(c, span, least=window) > EPS, r.std(c, span, least=window)))
    d = d.withColumns({"z_acf": z("acf"), "z_theta": z("theta")})
    return d.withColumn("warning", F.coalesce((F.col("z_acf") > limit) | (F.col("z_theta") < -limit), F.lit(False))).drop("_b", "_beta")


@bounded(lambda a: a["n"])
def crashes(df: DataFrame, drop: float = 0.05, n: int = 24, price: str = "close", by: By = ASSET) -> DataFrame:
    """drawdown from the highest price of the last n rows (fewer at the start), and whether it reaches `drop`."""
    top = Roll(by).max(price, n, least=1)
    return df.withColumn("drawdown", ratio(F.col(price) - top, top)).withColumn("crash", F.coalesce(F.col("drawdown") <= -drop, F.lit(False)))


@bounded(lambda a: a["before"])
def _seen_before(df: DataFrame, flag: str, before: int, by: By = ASSET) -> DataFrame:
    """df with _s: 1 if one of the `before` rows before has the flag."""
    seen = F.max(F.col(flag).cast("int")).over(Roll(by).w.rowsBetween(-before, -1))
    return df.withColumn("_s", F.coalesce(seen, F.lit(0)))


def lead_hits(df: DataFrame, warning: str = "warning", crash: str = "crash", before: int = 48, by: By = ASSET) -> DataFrame:
    """Per key: crashes, and those with a warning in the `before` rows before them."""
    d = _seen_before(df, warning, before, by=by).where(F.col(crash))
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("crashes"), F.sum("_s").alias("hits")).withColumn("hit_rate", F.col("hits") / F.col("crashes"))


def intervals(df: DataFrame, flag: str = "warning", by: By = ASSET, ts: str = "ts") -> DataFrame:
    """Runs of rows with the flag: start, end, rows. A run is what has the same number of rows without the flag before it."""
    d = running(df, {"_g": (F.when(F.coalesce(F.col(flag), F.lit(False)), 0).otherwise(1), "sum")}, by, ts).where(F.col(flag))
    return d.groupBy(*by, "_g").agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("rows")).drop("_g")


@bounded(lambda a: a["n"] + a["scales"])
def fdi(df: DataFrame, n: int = 100, x: str = "close", scales: int = 8, by: By = ASSET) -> DataFrame:
    """Fractal dimension: 2 less the slope of ln(mean |x[t+l] - x[t]|) on ln l; each mean is a trimmed frame."""
    import math

    r = Roll(by)
    d = df.withColumns({f"_d{k}": F.abs(F.col(x) - r.lag(x, k)) for k in range(1, scales + 1)})
    mean = {k: F.when(F.count(x).over(r.frame(n)) >= n, F.avg(f"_d{k}").over(r.frame(n - k))) for k in range(1, scales + 1)}
    d = d.withColumns({f"_m{k}": F.when(m > 0, F.ln(m)) for k, m in mean.items()})
    logs = [math.log(k) for k in range(1, scales + 1)]
    mid = sum(logs) / scales
    slope = sum((F.col(f"_m{k}") * (logs[k - 1] - mid) for k in range(1, scales + 1)), F.lit(0.0)) / sum((v - mid) ** 2 for v in logs)
    return d.withColumn(f"fdi_{n}", 2 - slope).drop(*(f"_{c}{k}" for c in "dm" for k in range(1, scales + 1)))


def _rescaled(values: Column, n: int) -> tuple[Column, Column]:
    """Range of the running sum of deviations (with 0 in it) and population deviation of an array of n values."""
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / n
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("at", "hi", "lo", "sq")), mean.alias("mean"))
    step = lambda s, v: F.struct(
        (s["at"] + v - s["mean"]).alias("at"), F.greatest(s["hi"], s["at"] + v - s["mean"]).alias("hi"), F.least(s["lo"], s["at"] + v - s["mean"]).alias("lo"),
        (s["sq"] + (v - s["mean"]) * (v - s["mean"])).alias("sq"), s["mean"].alias("mean"),
    )
    walked = F.aggregate(values, zero, step, lambda s: F.struct((s["hi"] - s["lo"]).alias("range"), F.sqrt(s["sq"] / n).alias("std")))
    return walked["range"], walked["std"]


@bounded(lambda a: a["n"] + 1)
def hurst(df: DataFrame, n: int = 100, x: str = "close", by: By = ASSET, log_returns: bool = False, name: str | None = None) -> DataFrame:
    """Rescaled-range exponent of the last n values, ln(R/S) / ln n; 0.5 where nothing varies.

    log_returns: of their n - 1 log returns, over ln(n - 1) and clipped to 0..1.
    """
    r = Roll(by)
    d = df.withColumn("_x", log_ratio(F.col(x), r.lag(x)) if log_returns else F.col(x))
    m = n - 1 if log_returns else n
    span, std = _rescaled(F.col("_a"), m)
    d = d.withColumn("_a", F.collect_list("_x").over(r.frame(m))).withColumns({"_r": span, "_s": std})
    h = F.ln(F.col("_r") / F.col("_s")) / F.ln(F.lit(float(m)))
    value = F.when((F.col("_s") > 1e-12) & (F.col("_r") > 0), clip(h, 0.0, 1.0) if log_returns else h).otherwise(0.5)
    return d.withColumn(name or f"hurst_{n}", F.when(F.size("_a") == m, value)).drop("_x", "_a", "_r", "_s")


@bounded(lambda a: a["n"])
def entropy(df: DataFrame, n: int = 100, x: str = "diff", bins: int = 50, by: By = ASSET) -> DataFrame:
    """Shannon entropy (nats) of a histogram of the last n values with equal bins from least to most, the last one closed."""
    r = Roll(by)
    w = r.frame(n)
    d = df.withColumns({"_lo": F.min(x).over(w), "_hi": F.max(x).over(w), "_a": F.collect_list(x).over(w)})
    place = lambda v: F.least(F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("int")
    d = d.withColumn("_b", F.when(F.col("_hi") > F.col("_lo"), F.array_sort(F.transform("_a", place))))
    # In order, equal bins are neighbours: each run's length is a bin's count.
    walked = F.aggregate(
        "_b", F.struct(F.lit(-1).alias("bin"), F.lit(0.0).alias("c"), F.lit(0.0).alias("h")),
        lambda s, b: F.when(b == s["bin"], F.struct(s["bin"].alias("bin"), (s["c"] + 1).alias("c"), s["h"].alias("h"))).otherwise(
            F.struct(b.alias("bin"), F.lit(1.0).alias("c"), (s["h"] - F.when(s["c"] > 0, s["c"] / n * F.ln(s["c"] / n)).otherwise(0.0)).alias("h"))
        ),
        lambda s: s["h"] - F.when(s["c"] > 0, s["c"] / n * F.ln(s["c"] / n)).otherwise(0.0),
    )
    return d.withColumn(f"entropy_{n}", F.when(F.size("_a") == n, F.coalesce(walked, F.lit(0.0)))).drop("_lo", "_hi", "_a", "_b")


@bounded(lambda a: a["n"])
def deviation(df: DataFrame, x: str, n: int, name: str, by: By = ASSET) -> DataFrame:
    """df with the standard deviation of the last n values."""
    return df.withColumn(name, Roll(by).std(x, n))


def with_key(df: DataFrame, by: By, **aggs: Column) -> DataFrame:
    """df with aggregates of its key, which are worked out apart and joined back."""
    keys = [f"_k{i}" for i in range(len(by))]
    whole = df.groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True))).agg(*(a.alias(n) for n, a in aggs.items()))
    same = F.lit(True)
    for c, k in zip(by, keys, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    return df.join(whole, same).drop(*keys)


def energy(df: DataFrame, x: str = "log_ret", n: int = 20, by: By = ASSET) -> DataFrame:
    """Product of the clipped z-scores of volatility and of absolute return, scaled to 0..1 per key."""
    d = deviation(df, x, n, "_v", by=by).withColumn("_a", F.abs(x))
    d = with_key(d, by, _vm=F.avg("_v"), _vs=F.stddev_samp("_v"), _am=F.avg("_a"), _as=F.stddev_samp("_a"))
    z = lambda c: clip(F.coalesce(ratio(F.col(c) - F.col(f"{c}m"), F.col(f"{c}s")), F.lit(0.0)), 0.0, 5.0)
    d = with_key(d.withColumn("_e", z("_v") * z("_a")), by, _lo=F.min("_e"), _hi=F.max("_e"))
    return d.withColumn("energy", F.coalesce(ratio(F.col("_e") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))).drop("_v", "_a", "_vm", "_vs", "_am", "_as", "_e", "_lo", "_hi")


@bounded(lambda a: 2 * a["n"])
def vol_of_vol(df: DataFrame, x: str = "log_ret", n: int = 24, by: By = ASSET) -> DataFrame:
    d = df.withColumn("vol", Roll(by).std(x, n))
    return d.withColumn("vol_of_vol", Roll(by).std("vol", n))


@bounded(lambda a: a["n"])
def rolling_corr(df: DataFrame, a: str, b: str, n: int, name: str, by: By = ASSET) -> DataFrame:
    w = Roll(by).frame(n)
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    d = df.withColumns({"_a": F.when(both, F.col(a)), "_b": F.when(both, F.col(b))})
    spread = F.stddev_pop("_a").over(w) * F.stddev_pop("_b").over(w)
    return d.withColumn(name, F.when(F.count("_a").over(w) >= n, ratio(F.covar_pop("_a", "_b").over(w), F.when(spread > EPS**2, spread)))).drop("_a", "_b")


@bounded(lambda a: a["limit"])
def _fill_near(df: DataFrame, columns: Sequence[str], limit: int, by: By = ASSET) -> DataFrame:
    r = Roll(by)
    return df.withColumns({c: r.last(c, limit) for c in columns})


def fill(df: DataFrame, columns: Sequence[str], limit: int | None = None, default: float | str | None = None, by: By = ASSET) -> DataFrame:
    """Nulls take the latest value of at most `limit` rows before, then the default: a number, or "median" for that of their key."""
    if limit is None:
        d = running(df, {f"_f_{c}": (F.col(c), "last") for c in columns}, by).withColumns({c: F.col(f"_f_{c}") for c in columns}).drop(*(f"_f_{c}" for c in columns))
    else:
        d = _fill_near(df, columns, limit, by=by)
    if default == "median":
        middle = exact(d, columns, [0.5], by).groupBy(*(F.col(k).alias(f"_k_{k}") for k in by)).pivot("metric", [*columns]).agg(F.first(F.col("values")[0]))
        middle = middle.select(*(f"_k_{k}" for k in by), *(F.col(c).alias(f"_m_{c}") for c in columns))
        d = d.join(middle, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by)))
        return d.withColumns({c: F.coalesce(c, f"_m_{c}") for c in columns}).drop(*(f"_m_{c}" for c in columns), *(f"_k_{k}" for k in by))
    return d if default is None else d.withColumns({c: F.coalesce(c, F.lit(default)) for c in columns})


@bounded(lambda a: a["n"])
def mode_smooth(df: DataFrame, x: str, n: int = 3, by: By = ASSET, name: str = "smooth") -> DataFrame:
    """The most frequent of the last n values; of equally frequent ones the smallest."""
    return df.withColumn(name, F.mode(F.col(x), True).over(Roll(by).frame(n)))


def profile(df: DataFrame, columns: Sequence[str], by: By = ASSET) -> DataFrame:
    """A row per key and column: count, mean, std, least, quartiles, most."""
    long = df.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns))).alias("_m")).select(*(F.col(k).alias(f"_k_{k}") for k in by), "_m.metric", "_m.value")
    sums = long.groupBy(*(f"_k_{k}" for k in by), "metric").agg(F.count("value").alias("_n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most"))
    quarters = exact(df, columns, [0.25, 0.5, 0.75], by)
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by))
    both = quarters.join(sums.withColumnRenamed("metric", "_metric"), same & (F.col("metric") == F.col("_metric")))
    return both.select(*by, "metric", F.col("_n").alias("n"), "mean", "std", "least", *(F.col("values")[i].alias(c) for i, c in enumerate(("q25", "median", "q75"))), "most")


def compare(profiles: DataFrame, a: str, b: str, key: str = "asset") -> DataFrame:
    """Means of two keys beside each other, their difference and that in percent."""
    pick = lambda k, n: profiles.where(F.col(key) == k).select("metric", F.col("mean").alias(n))
    d = pick(a, "mean_a").join(pick(b, "mean_b"), "metric")
    return d.withColumn("difference", F.col("mean_b") - F.col("mean_a")).withColumn("percent", 100 * ratio("difference", F.abs("mean_a")))

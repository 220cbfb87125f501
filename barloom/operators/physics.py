"""Models of mean reversion and of two wells, fitted from moments; potentials and seeded paths; fractional differences."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import Roll, bounded, ratio
from barloom.shipping import ship

By = Sequence[str]
ASSET = ("asset",)


@bounded(lambda a: 1)
def _before(df: DataFrame, x: str, by: By = ASSET) -> DataFrame:
    return df.withColumn("_b", Roll(by).lag(x))


@bounded(ahead=lambda a: 1)
def _after(df: DataFrame, x: str, by: By = ASSET) -> DataFrame:
    return df.withColumn("_d", Roll(by).lead(x) - F.col(x))


def ou_fit(df: DataFrame, x: str = "close", dt: float = 1.0, by: By = ASSET) -> DataFrame:
    """Per key, from the regression of x on its predecessor: theta, mu, sigma, half-life and R2. One pass of moments.

    theta and half-life are null unless the slope is in (0, 1).
    """
    d = _before(df, x, by=by).where(F.col("_b").isNotNull() & F.col(x).isNotNull())
    m = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("_mx"), F.avg("_b").alias("_mb"), F.var_pop(x).alias("_vx"), F.var_pop("_b").alias("_vb"), F.covar_pop(x, "_b").alias("_c"))
    m = m.withColumn("beta", ratio("_c", "_vb")).withColumn("alpha", F.col("_mx") - F.col("beta") * F.col("_mb"))
    m = m.withColumn("_res", F.greatest(F.col("_vx") - F.col("beta") * F.col("_c"), F.lit(0.0)))
    inside = (F.col("beta") > 0) & (F.col("beta") < 1)
    m = m.withColumn("theta", F.when(inside, -F.ln("beta") / dt))
    return m.select(
        *by, "n", "beta", "alpha", "theta", F.when(inside, F.col("alpha") / (1 - F.col("beta"))).alias("mu"),
        F.when(inside, F.sqrt(F.col("_res") * 2 * F.col("theta") / (1 - F.col("beta") * F.col("beta")))).alias("sigma"),
        F.when(inside, F.ln(F.lit(2.0)) / F.col("theta")).alias("half_life"), ratio(F.col("_c") * F.col("_c"), F.col("_vx") * F.col("_vb")).alias("r2"),
    )


def double_well_fit(df: DataFrame, x: str, by: By = ASSET) -> DataFrame:
    """Per key a and b of the drift a x - b x^3, by least squares of the next difference on (x, -x^3), without intercept."""
    d = _after(df, x, by=by).where("_d IS NOT NULL")
    s = lambda e: F.sum(F.expr(e))
    m = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), s(f"pow({x},2)").alias("_2"), s(f"pow({x},4)").alias("_4"), s(f"pow({x},6)").alias("_6"), s(f"{x}*_d").alias("_y1"), s(f"pow({x},3)*_d").alias("_y3"))
    det = F.col("_2") * F.col("_6") - F.col("_4") * F.col("_4")
    m = m.withColumn("a", ratio(F.col("_6") * F.col("_y1") - F.col("_4") * F.col("_y3"), det)).withColumn("b", ratio(F.col("_4") * F.col("_y1") - F.col("_2") * F.col("_y3"), det))
    two = F.coalesce((F.col("a") > 0) & (F.col("b") > 0), F.lit(False))
    return m.select(*by, "n", "a", "b", two.alias("bistable"), F.when(two, F.sqrt(F.col("a") / F.col("b"))).alias("well"), F.when(two, F.sqrt(F.col("a") / (3 * F.col("b")))).alias("tipping"))


def potential(fits: DataFrame, lo: float = -2.0, hi: float = 2.0, points: int = 41, by: By = ASSET) -> DataFrame:
    """V(x) = -a x^2 / 2 + b x^4 / 4 on a grid."""
    step = (hi - lo) / (points - 1)
    d = fits.select(*by, "a", "b", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")).withColumn("x", F.lit(lo) + F.col("k") * step)
    return d.select(*by, "k", "x", (-F.col("a") * F.pow("x", F.lit(2.0)) / 2 + F.col("b") * F.pow("x", F.lit(4.0)) / 4).alias("v"))


def simulate(fits: DataFrame, kind: str = "ou", paths: int = 8, steps: int = 100, dt: float = 1.0, sigma: float = 0.1, seed: int = 42, by: By = ASSET) -> DataFrame:
    """Seeded Euler paths of each fit: by, path, step, x. Each path is worked out where its row lies.

    kind "ou": theta, mu, sigma of the fits, starting at mu. kind "well": a, b and the given sigma, starting at 0, kept within +-10.
    """
    ship(fits.sparkSession)
    columns = ["theta", "mu", "sigma"] if kind == "ou" else ["a", "b"]
    rows = fits.select(*by, *columns, F.explode(F.sequence(F.lit(0), F.lit(paths - 1))).alias("path"))
    rows = rows.withColumn("_seed", F.pmod(F.xxhash64(*by, "path", F.lit(seed)), F.lit(2**31)))
    schema = f"{', '.join(f'{c} {rows.schema[c].dataType.simpleString()}' for c in by)}, path INT, step INT, x DOUBLE"

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.to_dict("records"):
                noise, x, out = np.random.default_rng(int(r["_seed"])).standard_normal(steps), r.get("mu") or 0.0, []
                for e in noise:
                    drift = r["theta"] * (r["mu"] - x) if kind == "ou" else r["a"] * x - r["b"] * x**3
                    x = float(np.clip(x + drift * dt + (r["sigma"] if kind == "ou" else sigma) * np.sqrt(dt) * e, *((-np.inf, np.inf) if kind == "ou" else (-10, 10))))
                    out.append(x)
                yield pd.DataFrame({**{c: [r[c]] * steps for c in by}, "path": r["path"], "step": range(steps), "x": out})

    return rows.dropna(subset=columns).mapInPandas(work, schema)


def frac_weights(d: float, cut: float = 1e-5, most: int = 2048) -> list[float]:
    """w0 = 1, wk = -w(k-1) (d - k + 1) / k, until |w| < cut."""
    w = [1.0]
    while len(w) < most:
        x = -w[-1] * (d - len(w) + 1) / len(w)
        if abs(x) < cut:
            break
        w.append(x)
    return w


@bounded(lambda a: len(frac_weights(a["d"], a["cut"], a["most"])) if a["d"] else 0)
def frac_diff(df: DataFrame, d: float = 0.5, x: str = "close", cut: float = 1e-5, most: int = 2048, by: By = ASSET, name: str = "frac_diff") -> DataFrame:
    """Fractional difference as a finite filter over the last values; null until the filter is full; d = 0 copies.

    A task holds one window of the filter's length at a time, so memory does not grow with the history.
    """
    if d == 0:
        return df.withColumn(name, F.col(x))
    w = frac_weights(d, cut, most)
    n, r = len(w), Roll(by)
    weights = F.array(*map(F.lit, w[::-1]))
    held = df.withColumn("_a", F.collect_list(x).over(r.frame(n)))
    dot = F.aggregate(F.zip_with("_a", weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return held.withColumn(name, F.when(F.size("_a") == n, dot)).drop("_a")


@bounded(lambda a: max((len(w) for w in a["weights"].values()), default=1))
def _filtered(df: DataFrame, columns: Sequence[str], weights: dict[float, list[float]], by: By = ASSET) -> DataFrame:
    r = Roll(by)
    of = F.create_map(*(x for d, w in weights.items() for x in (F.lit(d), F.array(*map(F.lit, w[::-1])))))
    most = max(map(len, weights.values()))
    d = df.withColumn("_w", F.try_element_at(of, F.col("_d"))).withColumns({f"_a_{c}": F.collect_list(c).over(r.frame(most)) for c in columns})
    last = lambda c: F.slice(f"_a_{c}", F.size(f"_a_{c}") - F.size("_w") + 1, F.size("_w"))
    dot = lambda c: F.aggregate(F.zip_with(last(c), F.col("_w"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    full = lambda c: F.col("_w").isNotNull() & (F.size(f"_a_{c}") >= F.size("_w"))
    return d.withColumns({f"{c}_fd": F.when(full(c), dot(c)) for c in columns}).drop("_w", *(f"_a_{c}" for c in columns))


def frac_diff_panel(df: DataFrame, orders: DataFrame, columns: Sequence[str], grid: Sequence[float] = tuple(k / 20 for k in range(14)), cut: float = 1e-3, most: int = 2048, by: By = ASSET) -> DataFrame:
    """Several columns' fractional differences, <column>_fd, with a d of each key's own.

    orders: by and d, as find_min_d() gives it; d of the grid (0 copies). Null until a key's filter is full, for keys
    without d, and for a d that is not in the grid. Columns without gaps are taken for granted, as in frac_diff().
    """
    weights = {float(d): frac_weights(d, cut, most) if d else [1.0] for d in grid}
    held = df.join(orders.select(*by, F.col("d").cast("double").alias("_d")), list(by), "left")
    return _filtered(held, columns, weights, by=by).select(*df.columns, *(f"{c}_fd" for c in columns))


#: Response surface (MacKinnon 2010) of the Dickey-Fuller statistic with a constant: value at 5 %, and its terms in 1/n.
ADF_5 = (-2.86154, -2.8903, -4.234, -40.04)


def adf_statistic(x: np.ndarray) -> float | None:
    """t-statistic of the level in a Dickey-Fuller regression with a constant and one lagged difference."""
    dx = np.diff(x)
    if len(dx) < 10:
        return None
    y, a = dx[1:], np.stack([np.ones(len(dx) - 1), x[1:-1], dx[:-1]], 1)
    if np.linalg.matrix_rank(a) < 3:
        return None
    inverse = np.linalg.inv(a.T @ a)
    beta = inverse @ a.T @ y
    rest = y - a @ beta
    s2 = rest @ rest / (len(y) - 3)
    return float(beta[1] / np.sqrt(s2 * inverse[1, 1])) if s2 > 0 else None


def adf_limit(n: int) -> float:
    return sum(c / n**k for k, c in enumerate(ADF_5))


def find_min_d(df: DataFrame, x: str = "close", grid: Sequence[float] = tuple(k / 20 for k in range(14)), cap: float = 0.65, least: int = 50, sample: int = 500, share: float = 0.1, by: By = ASSET) -> DataFrame:
    """Per key the least d of the grid whose fractional difference is stationary at 5 %, else the cap.

    Calibrated on the first `share` of a history, at most `sample` rows (a bound of the method: a group never holds
    more); null for keys with fewer than `least` rows there.
    """
    ship(df.sparkSession)
    r = Roll(by)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    first = df.withColumn("_k", r.number()).where(F.col("_k") <= sample).join(sizes, list(by))
    first = first.where(F.col("_k") <= F.greatest(F.lit(least), F.ceil(F.col("_n") * share))).select(*by, "_k", F.col(x).cast("double").alias("_x"))
    keys = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)

    def work(f: pd.DataFrame) -> pd.DataFrame:
        x, found = f.sort_values("_k")["_x"].to_numpy(), None
        if len(x) >= least:
            found = cap
            for d in grid:
                w = frac_weights(d, 1e-3, len(x) // 2)
                t = adf_statistic(np.convolve(x, w, "valid") if d else x)
                if t is not None and t < adf_limit(len(x) - len(w)):
                    found = d
                    break
        return pd.DataFrame({**{c: [f[c].iloc[0]] for c in by}, "n": [len(x)], "min_d": [found]})

    return first.groupBy(*by).applyInPandas(work, f"{keys}, n LONG, min_d DOUBLE")

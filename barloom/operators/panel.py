"""Operators across assets: correlations of pairs, market factors, standardising, clustering of assets."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import ratio


#: Assets or features whose matrix of pairs the driver holds at most (32 MB).
MOST_NAMES = 2000


def pair_correlations(df: DataFrame, key: str = "asset", ts: str = "ts", x: str = "x") -> DataFrame:
    """a < b, n common times and their Pearson correlation. Assets of one time meet in a list, so only times are shuffled."""
    at = df.where(F.col(x).isNotNull()).groupBy(ts).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(x).alias("v")))).alias("l"))
    pairs = at.select(F.posexplode("l").alias("i", "p"), "l").select("p", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("q"))
    g = pairs.groupBy(F.col("p.k").alias("a"), F.col("q.k").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("p.v", "q.v").alias("_c"), (F.stddev_pop("p.v") * F.stddev_pop("q.v")).alias("_s"))
    return g.select("a", "b", "n", ratio("_c", "_s").alias("corr"))


def standardise(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("asset",), fit: DataFrame | None = None) -> DataFrame:
    """Each column's z-score by the key's mean and deviation, of the rows of `fit` (those of df without it)."""
    f = df if fit is None else fit
    m = f.groupBy(*by).agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_samp(c).alias(f"_s_{c}") for c in columns))
    return df.join(m, list(by), "left").withColumns({f"{c}_z": ratio(F.col(c) - F.col(f"_m_{c}"), f"_s_{c}") for c in columns}).drop(*(f"_{k}_{c}" for k in "ms" for c in columns))


def market_factor(df: DataFrame, ts: str = "ts", x: str = "x", volume: str = "volume") -> DataFrame:
    """Per time the mean and the volume-weighted mean over assets, each standardised over all times."""
    m = df.groupBy(ts).agg(F.avg(x).alias("mean"), ratio(F.sum(F.col(x) * F.col(volume)), F.sum(F.when(F.col(x).isNotNull(), F.col(volume)))).alias("weighted"))
    s = m.agg(*(f(c).alias(f"_{n}_{c}") for c in ("mean", "weighted") for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    z = lambda c: (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-8)
    return m.join(F.broadcast(s)).select(ts, z("mean").alias("mean"), z("weighted").alias("weighted"))  # s is one row


def merge_tree(distance: np.ndarray, method: str = "ward") -> list[tuple[int, int, float]]:
    """Agglomerative merges (a, b, height) of a small distance matrix by Lance-Williams updates; ward or average."""
    d, n = distance.astype(float).copy(), len(distance)
    np.fill_diagonal(d, np.inf)
    size, name, out = dict.fromkeys(range(n), 1), {i: i for i in range(n)}, []
    live = list(range(n))
    while len(live) > 1:
        sub = d[np.ix_(live, live)]
        i, j = divmod(int(sub.argmin()), len(live))
        a, b = sorted((live[i], live[j]))
        h = d[a, b]
        out.append((name[a], name[b], float(h)))
        for k in live:
            if k not in (a, b):
                if method == "ward":
                    t = size[a] + size[b] + size[k]
                    v = max(0.0, ((size[a] + size[k]) * d[a, k] ** 2 + (size[b] + size[k]) * d[b, k] ** 2 - size[k] * h**2) / t) ** 0.5
                else:
                    v = (size[a] * d[a, k] + size[b] * d[b, k]) / (size[a] + size[b])
                d[a, k] = d[k, a] = v
        size[a] += size[b]
        name[a] = n + len(out) - 1
        live.remove(b)
    return out


def cut_tree(merges: list[tuple[int, int, float]], n: int, k: int | None = None, height: float | None = None) -> list[int]:
    """Cluster 0.. of each leaf, in order of first leaf: k clusters, or no merge above the height."""
    use = merges[: n - k] if k is not None else [m for m in merges if m[2] <= height]
    parent = list(range(n + len(merges)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for m, (a, b, _) in enumerate(merges):
        if m < len(use):
            parent[top(a)] = parent[top(b)] = n + m
    names: dict[int, int] = {}
    return [names.setdefault(top(i), len(names)) for i in range(n)]


def matrix(pairs: DataFrame, most: int = MOST_NAMES) -> tuple[list[str], np.ndarray]:
    """Names and the matrix of a long table a, b, corr: one number per pair of assets or features, not per row of data.

    Fails for more than `most` names, since the matrix lies on the driver.
    """
    count = pairs.select(F.explode(F.array("a", "b"))).distinct().count()
    if count > most:
        raise ValueError(f"{count} names are more than the {most} whose matrix the driver holds")
    p = pairs.select("a", "b", "corr").toPandas()
    names = sorted(set(p.a) | set(p.b))
    at = {x: i for i, x in enumerate(names)}
    m = np.eye(len(names))
    for a, b, c in p.itertuples(index=False):
        m[at[a], at[b]] = m[at[b], at[a]] = 0.0 if c is None or np.isnan(c) else c
    return names, m


def pca_factor(df: DataFrame, key: str = "asset", ts: str = "ts", x: str = "x") -> DataFrame:
    """ts, factor: the first principal component of the assets' standardised x, its weights' largest positive; share: of the variance.

    Weights come from the matrix of pairwise correlations (one number per pair, MOST_NAMES assets at most); the factor is
    a weighted mean over the assets that a time has, so gaps do not make it null.
    """
    d = standardise(df.where(F.col(x).isNotNull()), [x], (key,))
    names, corr = matrix(pair_correlations(df, key, ts, x))
    values, vectors = np.linalg.eigh(corr)
    first = vectors[:, -1] * np.sign(vectors[np.abs(vectors[:, -1]).argmax(), -1])
    weights = df.sparkSession.createDataFrame(list(zip(names, first.tolist(), strict=True)), f"{key} STRING, _w DOUBLE")
    out = d.join(F.broadcast(weights), key).groupBy(ts).agg(ratio(F.sum(F.col(f"{x}_z") * F.col("_w")), F.sum(F.abs("_w"))).alias("factor"))  # weights: MOST_NAMES rows at most
    return out.withColumn("share", F.lit(float(values[-1] / len(names))))


def cluster_assets(df: DataFrame, k: int = 3, leader: str | None = None, least: int = 2) -> DataFrame:
    """asset, cluster by Ward's linkage of 1 - |correlation|; a leader is cluster 0 alone, the others have k - 1.

    df: asset, ts, x. An asset with no common times with any other, or fewer than `least` with all, is not in a pair: it
    goes to the largest cluster of the others. Fewer assets than clusters are a cluster each.
    """
    pairs = pair_correlations(df).where(F.col("n") >= least)
    names, corr = matrix(pairs)
    rest = [i for i, a in enumerate(names) if a != leader]
    k = min(k - (leader in names), len(rest))
    own = cut_tree(merge_tree(1 - np.abs(corr[np.ix_(rest, rest)])), len(rest), k=max(1, k))
    found = {names[i]: c + (leader in names) for i, c in zip(rest, own, strict=True)} | ({leader: 0} if leader in names else {})
    sizes = Counter(c for a, c in found.items() if a != leader)
    default = min(sizes, key=lambda c: (-sizes[c], c), default=0)
    held = df.sparkSession.createDataFrame(sorted(found.items()), "asset STRING, cluster INT")
    return df.select("asset").distinct().join(F.broadcast(held), "asset", "left").withColumn("cluster", F.coalesce("cluster", F.lit(default)))  # MOST_NAMES rows at most


def dominant(df: DataFrame, groups: DataFrame, x: str = "volume", key: str = "asset", group: str = "cluster") -> DataFrame:
    """Per group of assets (key, group): the asset of the largest sum of x, that sum, and its share of the group's.

    Of equal ones the first by name.
    """
    sums = df.groupBy(key).agg(F.sum(x).alias("total")).join(groups.select(key, group), key)
    best = sums.groupBy(group).agg(F.max(F.struct("total")).alias("_t"), F.sum("total").alias("_all"))
    top = sums.join(best, group).where(F.col("total") == F.col("_t.total"))
    return top.groupBy(group).agg(F.min(key).alias("dominant"), F.max("total").alias("total"), F.max(F.try_divide("total", "_all")).alias("share"))

"""Feature selection and latent factors. Moments of all features are one Spark aggregation; what follows works on that small matrix."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.sums import summed
from barloom.operators.panel import cut_tree, merge_tree


def correlation(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> np.ndarray:
    """Correlations of the columns over rows without nulls; 0 where a column does not vary."""
    v = VectorAssembler(inputCols=list(columns), outputCol="_v", handleInvalid="skip").transform(df.select(*columns))
    m = Correlation.corr(v, "_v", method).first()[0].toArray()
    return np.where(np.isfinite(m), m, 0.0) * (1 - np.eye(len(m))) + np.eye(len(m))


def correlated(df: DataFrame, columns: Sequence[str], y: str, limit: float = 0.95) -> list[str]:
    """Columns that stay when of each pair beyond the limit the one less correlated with y goes."""
    m = np.abs(correlation(df, [*columns, y]))
    to_y, gone = m[:-1, -1], set()
    for i in range(len(columns)):
        for j in range(i):
            if i not in gone and j not in gone and m[i, j] > limit:
                gone.add(i if to_y[i] <= to_y[j] else j)
    return [c for k, c in enumerate(columns) if k not in gone]


def clusters(df: DataFrame, columns: Sequence[str], height: float = 0.5, method: str = "spearman", linkage: str = "ward") -> dict[str, int]:
    """Column -> cluster by hierarchical linkage of 1 - |correlation|."""
    m = correlation(df, columns, method)
    return dict(zip(columns, cut_tree(merge_tree(1 - np.abs(m), linkage), len(columns), height=height), strict=True))


def small_clusters(df: DataFrame, columns: Sequence[str], most: int = 64) -> dict[str, int]:
    """Column -> cluster of at most `most` columns: average linkage, clusters that are too large split again. Columns that do not vary are alone."""
    var = df.agg(*(F.var_samp(c).alias(c) for c in columns)).first()
    live = [c for c in columns if (var[c] or 0) > 0]
    m = 1 - np.abs(correlation(df, live)) if live else np.zeros((0, 0))

    def split(at: list[int]) -> list[list[int]]:
        if len(at) <= most:
            return [at]
        own = cut_tree(merge_tree(m[np.ix_(at, at)], "average"), len(at), k=max(2, -(-len(at) // most)))
        return [g for c in sorted(set(own)) for g in split([i for i, o in zip(at, own, strict=True) if o == c])]

    groups = [[live[i] for i in g] for g in (split([*range(len(live))]) if live else [])] + [[c] for c in columns if c not in live]
    return {x: k for k, g in enumerate(groups) for x in g}


def mutual_information(df: DataFrame, columns: Sequence[str], y: str, bins: int = 10) -> DataFrame:
    """Information in nats about a class y in each column cut at its quantiles: feature, mi. Counts per bin, in one pass."""
    cuts = df.agg(*(F.percentile_approx(c, [k / bins for k in range(1, bins)], 1000).alias(c) for c in columns)).first()
    place = lambda c: F.aggregate(F.array(*map(F.lit, cuts[c])), F.lit(0), lambda s, q: s + (F.col(c) > q).cast("int"))
    long = df.select(F.col(y).alias("_y"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), place(c).alias("bin")) for c in columns))).alias("f")).select("_y", "f.feature", "f.bin")
    n = long.groupBy("feature", "bin", "_y").agg(F.count(F.lit(1)).alias("n"))
    both, a = n.groupBy("feature", "bin").agg(F.sum("n").alias("nb")), n.groupBy("feature", "_y").agg(F.sum("n").alias("ny"))
    t = n.groupBy("feature").agg(F.sum("n").alias("nt"))
    d = n.join(both, ["feature", "bin"]).join(a, ["feature", "_y"]).join(t, "feature")
    return d.groupBy("feature").agg(F.sum(F.col("n") / F.col("nt") * F.ln(F.col("n") * F.col("nt") / (F.col("nb") * F.col("ny")))).alias("mi"))


def leaders(df: DataFrame, columns: Sequence[str], limit: float = 0.85) -> list[str]:
    """In order of falling variance, columns not correlated beyond the limit with one taken before."""
    m = np.abs(correlation(df, columns))
    var = df.agg(*(F.var_samp(c).alias(c) for c in columns)).first()
    taken: list[int] = []
    for k in sorted(range(len(columns)), key=lambda i: (-(var[columns[i]] or 0), i)):
        if all(m[k, j] <= limit for j in taken):
            taken.append(k)
    return [columns[k] for k in taken]


@dataclass
class Gram:
    """Mean, and second moments about it, of columns and a target (the last)."""

    columns: list[str]
    n: int
    mean: list[float]
    cov: list[list[float]]

    @staticmethod
    def of(df: DataFrame, columns: Sequence[str], y: str) -> "Gram":
        """Two passes, for means and for products about them: a task sends one matrix, however many rows it has."""
        c = [*columns, y]
        v = df.select(*(F.col(x).cast("double").alias(x) for x in c)).dropna()
        sums = summed(v, c, lambda x: np.append([len(x[y])], [x[k].sum() for k in c]), len(c) + 1)
        n, mean = int(sums[0]), sums[1:] / max(sums[0], 1)

        def products(x: dict[str, np.ndarray]) -> np.ndarray:
            d = np.stack([x[k] for k in c], axis=1) - mean
            return d.T @ d

        m = summed(v, c, products, len(c) ** 2).reshape(len(c), len(c)) / max(n - 1, 1)
        return Gram(c, n, mean.tolist(), ((m + m.T) / 2).tolist())

    def r2(self, use: Sequence[int], ridge: float = 1e-6) -> float:
        """Share of the target's variance that a ridge regression on these columns explains."""
        m = np.array(self.cov)
        if not len(use) or m[-1, -1] <= 0:
            return 0.0
        a = m[np.ix_(use, use)] + ridge * np.diag(np.diag(m)[list(use)] + 1e-12)
        return float(m[-1, use] @ np.linalg.solve(a, m[use, -1]) / m[-1, -1])


def greedy(gram: Gram, penalty: float = 0.002, least: int = 20, most: int = 80) -> list[str]:
    """Columns taken one after another by the gain in R2, until the gain is below the penalty (`least` are taken anyway)."""
    taken, best, rest = [], 0.0, list(range(len(gram.columns) - 1))
    while rest and len(taken) < most:
        gain, k = max((gram.r2([*taken, i]) - best, -i) for i in rest)
        if gain < penalty and len(taken) >= least:
            break
        taken.append(-k)
        rest.remove(-k)
        best += gain
    return [gram.columns[i] for i in taken]


def budget(gram: Gram, groups: dict[str, int], n: int = 25, limit: float = 0.85) -> list[str]:
    """At most n columns: clusters in order of the share of the target's variance they explain, each with places in
    proportion to it (one at least) for its columns of most variance that are not alike beyond the limit."""
    cov, at = np.array(gram.cov), {c: i for i, c in enumerate(gram.columns)}
    s = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    score = {g: max(0.0, gram.r2([at[x] for x in groups if groups[x] == g])) for g in set(groups.values())}
    total, out = sum(score.values()) + 1e-9, []
    for g in sorted(score, key=lambda g: (-score[g], g)):
        if len(out) >= n:
            break
        taken: list[int] = []
        for i in sorted((at[x] for x in groups if groups[x] == g), key=lambda i: (-cov[i, i], i)):
            if all(abs(cov[i, j]) <= limit * s[i] * s[j] for j in taken):
                taken.append(i)
        out += [gram.columns[i] for i in taken[: max(1, int(n * score[g] / total))]]
    return out[:n]


def intrinsic_dimension(cov: np.ndarray, n: int) -> dict[str, float]:
    """Eigenvalues of the correlation matrix above the Marchenko-Pastur edge, and the participation ratio."""
    s = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    e = np.linalg.eigvalsh(cov / np.outer(s, s))
    edge = (1 + np.sqrt(len(e) / max(n, 1))) ** 2
    return {"marchenko_pastur": int((e > edge).sum()), "participation": float(e.sum() ** 2 / (e**2).sum())}


@dataclass
class Latents:
    """Principal components of each cluster of columns."""

    groups: list[list[str]]
    mean: list[list[float]]
    scale: list[list[float]]
    axes: list[list[list[float]]]
    selected: list[str] = field(default_factory=list)
    rank: dict[str, float] = field(default_factory=dict)
    talk: dict = field(default_factory=dict)

    def transform(self, df: DataFrame, mode: str = "full_latents") -> DataFrame:
        """df with columns tf_cluster{c}_pc{k} as plain sums of its columns (mode "selected": only those selected).

        Where clusters have been residualised, the sums are of residuals, which come along as tt_{column}.
        """
        out: dict[str, Column] = {}
        if self.talk:
            df = Talk(**self.talk).transform(df)
            own = {x: f"tt_{x}" for x in self.talk["columns"]}
        else:
            own = {}
        for c, (g, m, s, axes) in enumerate(zip(self.groups, self.mean, self.scale, self.axes, strict=True)):
            g = [own.get(x, x) for x in g]
            for k, axis in enumerate(axes):
                out[f"tf_cluster{c}_pc{k}"] = sum(((F.coalesce(F.col(x), F.lit(a)) - a) / b * w for x, a, b, w in zip(g, m, s, axis, strict=True)), F.lit(0.0))
        if mode == "selected":
            out = {k: v for k, v in out.items() if k in self.selected}
        return df.withColumns(out)

    def select(self, keep: int = 8, stability: dict[str, float] | None = None) -> list[str]:
        """The `keep` components that are best by rank, times their stability if it is given; these are `selected` from now on."""
        score = {k: v * (stability or {}).get(k, 1.0) for k, v in self.rank.items()}
        self.selected = sorted(score, key=lambda k: (-score[k], k))[:keep]
        return self.selected

    def save(self, spark: SparkSession, path: str) -> None:
        """One row of JSON in a table, on whatever storage the path is."""
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model STRING").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Latents":
        return Latents(**json.loads(spark.read.parquet(path).first()[0]))


@dataclass
class Talk:
    """What clusters say of each other, taken out: residuals as sums of the columns' distances from their means."""

    columns: list[str]
    mean: list[float]
    weights: list[list[float]]
    steps: list[list] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """df with tt_{column}: the residual of each column; nulls count as the mean."""
        away = [F.coalesce(F.col(x), F.lit(m)) - m for x, m in zip(self.columns, self.mean, strict=True)]
        return df.withColumns({f"tt_{x}": sum((w * a for w, a in zip(row, away, strict=True) if w), F.lit(m)) for x, m, row in zip(self.columns, self.mean, self.weights, strict=True)})


def likeness(cov: np.ndarray, a: Sequence[int], b: Sequence[int]) -> float:
    """Mean |correlation| between two sets of columns."""
    s = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    return float(np.abs(cov[np.ix_(a, b)] / np.outer(s[a], s[b])).mean())


def tensor_talk(gram: Gram, groups: dict[str, int], alphas: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0), pairs: int = 2, weight: float = 0.5, fixed: Sequence[tuple[int, int, float]] | None = None) -> tuple[Talk, Gram]:
    """Clusters residualised one after another, and the moments of the residuals.

    Each cluster speaks to the `pairs` others most like it. What a regression on the one explains of the other is taken out
    times alpha, whichever leaves the least likeness plus weight times what is lost of the likeness with the target; 0 takes
    out nothing. Pairs come in order of falling likeness. fixed: (source, target, alpha) in place of that choice. A step
    is a linear map of the columns, so regressions, likeness and the next step's moments all follow from one matrix of
    moments; data are read once, for that.
    """
    cov, names = np.array(gram.cov), sorted(set(groups.values()))
    at = {c: [i for i, x in enumerate(gram.columns[:-1]) if groups.get(x) == c] for c in names}
    p, steps = len(cov), []
    whole = np.eye(p)

    def mapped(source: int, target: int, alpha: float) -> np.ndarray:
        i, j = at[source], at[target]
        t = np.eye(p)
        t[np.ix_(j, i)] = -alpha * np.linalg.lstsq(cov[np.ix_(i, i)], cov[np.ix_(i, j)], rcond=1e-10)[0].T
        return t

    if fixed is None:
        said = {(a, b) for a in names for b in sorted((b for b in names if b != a), key=lambda b: (-likeness(cov, at[a], at[b]), b))[:pairs]}
        order = [(a, b, None) for a, b in sorted(said, key=lambda ab: (-likeness(cov, at[ab[0]], at[ab[1]]), ab))]
    else:
        order = [*fixed]
    for source, target, alpha in order:
        if alpha is None:
            base, tried = likeness(cov, at[target], [p - 1]), []
            for a in alphas:
                t = mapped(source, target, a)
                m = t @ cov @ t.T
                tried.append((likeness(m, at[source], at[target]) + weight * max(0.0, base - likeness(m, at[target], [p - 1])), a))
            alpha = min(tried)[1]
        if alpha:
            t = mapped(source, target, alpha)
            cov, whole = t @ cov @ t.T, t @ whole
            steps.append([source, target, float(alpha)])
    talk = Talk(gram.columns[:-1], gram.mean[:-1], whole[:-1, :-1].tolist(), steps)
    return talk, Gram(gram.columns, gram.n, gram.mean, cov.tolist())


@dataclass
class Logit:
    """A logistic model of some columns: weights (the last is of 1), the logarithm of its likelihood, the rows it was fitted on."""

    columns: list[str]
    weights: np.ndarray
    log: float
    n: int


def logit(df: DataFrame, columns: Sequence[str], y: str, start: np.ndarray | None = None, rounds: int = 25, ridge: float = 1e-6) -> Logit:
    """Fitted by Newton's method: a round is a pass that returns a gradient and a Hessian, until the likelihood stands still.

    A ridge keeps separable data finite; rows with nulls are left out. start: weights to begin with.
    """
    c = list(columns)
    d = len(c) + 1
    rows = df.select(*(F.col(x).cast("double").alias(x) for x in (*c, y))).dropna()
    b = np.zeros(d) if start is None else np.array(start, float)

    def sums(b: np.ndarray) -> tuple[float, int, np.ndarray, np.ndarray]:
        def add(v: dict[str, np.ndarray]) -> np.ndarray:
            x, t = np.column_stack([*(v[k] for k in c), np.ones(len(v[y]))]), v[y]
            z = x @ b
            q = 1 / (1 + np.exp(-z))
            return np.concatenate([[(t * z - np.logaddexp(0, z)).sum(), len(t)], x.T @ (t - q), (x.T @ (x * (q * (1 - q))[:, None])).ravel()])

        s = summed(rows, [*c, y], add, 2 + d + d * d)
        return s[0] - ridge / 2 * b @ b, int(s[1]), s[2 : 2 + d] - ridge * b, s[2 + d :].reshape(d, d) + ridge * np.eye(d)

    log, n, gradient, hessian = sums(b)
    for _ in range(rounds):
        step = np.linalg.solve(hessian, gradient)
        while True:  # shorter, if the likelihood would fall
            more = sums(b + step)
            if more[0] >= log - 1e-9 * abs(log) or np.abs(step).max() < 1e-9:
                break
            step = step / 2
        b, gain = b + step, more[0] - log
        log, n, gradient, hessian = more
        if gain < 1e-9 * abs(log):
            break
    return Logit(c, b, log, n)


def score_tests(df: DataFrame, model: Logit, columns: Sequence[str], y: str) -> dict[str, float]:
    """Column -> the score statistic of adding it to the model: about twice what the likelihood's logarithm would gain.

    All columns in one pass; a task sends sums of each column with the residual, with itself and with the model's columns.
    Columns are taken about their means, so rows with nulls in them count as average there.
    """
    c, m, d = list(columns), len(columns), len(model.columns) + 1
    own = list(model.columns)
    rows = df.select(*(F.col(x).cast("double").alias(x) for x in dict.fromkeys((*own, y, *c)))).dropna(subset=[*own, y])
    b = model.weights

    def add(v: dict[str, np.ndarray]) -> np.ndarray:
        x, t = np.column_stack([*(v[k] for k in own), np.ones(len(v[y]))]), v[y]
        q = 1 / (1 + np.exp(-(x @ b)))
        w = q * (1 - q)
        z = np.column_stack([v[k] for k in c])
        z = np.where(np.isnan(z), mean, z) - mean
        return np.concatenate([z.T @ (t - q), (z * z * w[:, None]).sum(axis=0), (z.T @ (x * w[:, None])).ravel(), (x.T @ (x * w[:, None])).ravel()])

    stats = rows.agg(*(F.avg(F.nanvl(x, F.lit(None))).alias(f"m{k}") for k, x in enumerate(c))).first()
    mean = np.array([stats[k] or 0.0 for k in range(m)])
    s = summed(rows, [*dict.fromkeys((*own, y, *c))], add, 2 * m + m * d + d * d)
    u, zz, zx, xx = s[:m], s[m : 2 * m], s[2 * m : 2 * m + m * d].reshape(m, d), s[2 * m + m * d :].reshape(d, d)
    left = zz - np.einsum("id,id->i", zx, np.linalg.lstsq(xx, zx.T, rcond=1e-12)[0].T)
    return dict(zip(c, np.where(left > 1e-9 * np.maximum(zz, 1e-12), u * u / np.maximum(left, 1e-12), 0.0).tolist(), strict=True))


def greedy_classifier(df: DataFrame, columns: Sequence[str], y: str, gain: float = 3.84, least: int = 0, most: int = 80) -> list[tuple[str, float]]:
    """Columns taken one after another for a logistic model of y (0 or 1), with what each adds to twice the likelihood's logarithm.

    Each step tests all columns that are left in one pass, takes the best and fits the model again from where it was. It
    ends where the best adds less than `gain` (`least` are taken anyway). Rows with nulls in y, or in columns taken, are
    left out from then on.
    """
    rows = df.where(F.col(y).isNotNull())
    rest, model, out = list(columns), logit(rows, [], y), []
    while rest and len(out) < most:
        tests = score_tests(rows, model, rest, y)
        best = max(rest, key=lambda c: (tests[c], -rest.index(c)))
        if tests[best] < gain and len(out) >= least:
            break
        kept = rows.where(F.col(best).isNotNull())
        lost = kept.dropna(subset=[*model.columns]).count() < model.n if model.columns else kept.count() < model.n
        if lost:
            rows, model = kept, logit(kept, model.columns, y, model.weights)
        new = logit(rows, [*model.columns, best], y, np.append(np.append(model.weights[:-1], 0.0), model.weights[-1]))
        out.append((best, float(2 * (new.log - model.log))))
        rest.remove(best)
        model = new
    return out


def latents(gram: Gram, groups: dict[str, int], per_cluster: int = 2, keep: int = 8, weight: float = 0.5, talk: Talk | None = None) -> Latents:
    """Components of each cluster's correlation matrix. Their rank is (1 - weight) x share of variance + weight x
    |correlation with the target|, each as a share of the largest; select() can weigh it by a stability. talk: gram is of its residuals."""
    cov, at = np.array(gram.cov), {c: i for i, c in enumerate(gram.columns)}
    out, share, tie = Latents([], [], [], []), {}, {}
    for c in sorted(set(groups.values())):
        cols = [x for x in groups if groups[x] == c and cov[at[x], at[x]] > 1e-12]
        if not cols:
            continue
        i = [at[x] for x in cols]
        s = np.sqrt(np.diag(cov)[i])
        e, v = np.linalg.eigh(cov[np.ix_(i, i)] / np.outer(s, s))
        top = v[:, ::-1][:, :per_cluster]
        top = top * np.where(top[np.abs(top).argmax(axis=0), range(top.shape[1])] < 0, -1, 1)
        to_y = (top.T @ (cov[i, -1] / s)) / np.sqrt(np.maximum(e[::-1][:per_cluster] * cov[-1, -1], 1e-12))
        for k in range(top.shape[1]):
            name = f"tf_cluster{len(out.groups)}_pc{k}"
            share[name], tie[name] = float(e[::-1][k] / len(cols)), float(abs(to_y[k]))
        out.groups.append(cols)
        out.mean.append([gram.mean[k] for k in i])
        out.scale.append(s.tolist())
        out.axes.append(top.T.tolist())
    most = [max([*d.values(), 1e-12]) for d in (share, tie)]
    out.rank = {k: (1 - weight) * share[k] / most[0] + weight * tie[k] / most[1] for k in share}
    out.select(keep)
    out.talk = asdict(talk) if talk else {}
    return out


def residualise(gram: Gram, groups: dict[str, int], alphas: Sequence[float] = (0.25, 0.5, 0.75, 1.0)) -> dict[int, float]:
    """Per cluster the share of what the other clusters' means explain that is best taken out: least correlation between
    clusters and least loss of correlation with the target, from the moments alone."""
    cov, names = np.array(gram.cov), sorted(set(groups.values()))
    s = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    w = np.zeros((len(names) + 1, len(cov)))
    for r, c in enumerate(names):
        own = [i for i, x in enumerate(gram.columns[:-1]) if groups.get(x) == c]
        w[r, own] = 1 / (len(own) * s[own])
    w[-1, -1] = 1 / s[-1]
    m, out = w @ cov @ w.T, {}
    for r, c in enumerate(names):
        o = [k for k in range(len(names)) if k != r]
        if not o:
            out[c] = 0.0
            continue
        beta = np.linalg.solve(m[np.ix_(o, o)] + 1e-6 * np.eye(len(o)), m[o, r])
        best = []
        for a in alphas:
            v = np.zeros(len(names) + 1)
            v[r], v[o] = 1.0, -a * beta
            var = max(v @ m @ v, 1e-12)
            others = np.abs(m[o] @ v / np.sqrt(np.diag(m)[o] * var)).mean()
            loss = abs(m[-1, r]) / np.sqrt(m[r, r] * m[-1, -1]) - abs(m[-1] @ v) / np.sqrt(var * m[-1, -1])
            best.append((others + 0.5 * max(0.0, loss), a))
        out[c] = min(best)[1]
    return out


def fold_stability(df: DataFrame, columns: Sequence[str], y: str, fold: str = "fold") -> DataFrame:
    """feature, mean |correlation| with y over folds, and 1 / (1 + its coefficient of variation)."""
    cor = lambda c: F.try_divide(F.covar_pop(c, y), F.stddev_pop(c) * F.stddev_pop(y))
    g = df.where(F.col(fold).isNotNull()).groupBy(fold).agg(*(F.abs(cor(c)).alias(c) for c in columns))
    long = g.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in columns))).alias("x")).select("x.*")
    return long.groupBy("feature").agg(F.avg("r").alias("strength"), (1 / (1 + F.coalesce(F.try_divide(F.stddev_samp("r"), F.avg("r")), F.lit(0.0)))).alias("stability"))



def _until(fold: str, k: int) -> Column:
    """Rows that fold k trains on: all before it."""
    return F.coalesce(F.col(fold), F.lit(0)) < k


def correlation_stability(df: DataFrame, columns: Sequence[str], y: str, fold: str = "fold", n: int = 5, least: int = 50) -> DataFrame:
    """feature, stability: 1 / (1 + variation of its correlation with y over what folds 1..n train on), 0 without a correlation.

    Folds that train on fewer than `least` rows do not count. One pass: n correlations a column.
    """
    some = lambda k: F.count_if(_until(fold, k)).alias("n")
    def tie(c: str, k: int) -> Column:
        """The correlation of pairs without nulls; null where a column is constant (Spark's corr fails there)."""
        pair = _until(fold, k) & F.col(c).isNotNull() & F.col(y).isNotNull()
        one, two = F.when(pair, F.col(c)), F.when(pair, F.col(y))
        return F.try_divide(F.covar_pop(one, two), F.stddev_pop(one) * F.stddev_pop(two)).alias("r")

    g = df.agg(*(F.struct(some(k), tie(c, k)).alias(f"{i}_{k}") for i, c in enumerate(columns) for k in range(1, n + 1)))
    long = g.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"{i}_{k}.n"), F.col(f"{i}_{k}.r")) for i, c in enumerate(columns) for k in range(1, n + 1)))).alias("x")).select("x.*")
    r = F.when(F.col("n") >= least, F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0)))
    m = long.groupBy("feature").agg(F.avg(r).alias("m"), F.stddev_pop(r).alias("d"))
    return m.select("feature", F.when(F.abs("m") >= 1e-9, 1 / (1 + F.col("d") / (F.abs("m") + 1e-6))).otherwise(0.0).alias("stability"))


def l1_frequency(df: DataFrame, columns: Sequence[str], y: str, fold: str = "fold", n: int = 5, c: float = 0.1, least: float = 1e-3) -> dict[str, float]:
    """Column -> share of folds 1..n on whose training rows a logistic regression with an L1 penalty (strength 1 / c rows) keeps it."""
    wide = VectorAssembler(inputCols=list(columns), outputCol="_l", handleInvalid="skip").transform(df.select(*columns, y, fold)).cache()
    counts = np.zeros(len(columns))
    for k in range(1, n + 1):
        train = wide.where(_until(fold, k))
        rows = train.count()
        if rows:
            model = LogisticRegression(labelCol=y, featuresCol="_l", elasticNetParam=1.0, regParam=1 / (c * rows), maxIter=100).fit(train)
            counts += np.abs(model.coefficients.toArray()) > least
    wide.unpersist()
    return dict(zip(columns, (counts / n).tolist(), strict=True))


def tune_dimension(df: DataFrame, columns: Sequence[str], y: str, base: int, tp: float = 0.02, sl: float = 0.01, least: int = 1, fold: str = "fold", n: int = 2, ridge: float = 1.0) -> int:
    """How many of the components, in order, to keep: base or one less or more, whichever trades best on folds 1..n.

    A ridge classifier of the rows before a fold trades where it says 1; its score is the expectancy of those trades
    times the root of their number (-1 for fewer than 5), averaged over folds. Each fold is two passes.
    """
    tried = sorted({d for d in (max(least, base - 1), base, min(len(columns), base + 1)) if 1 <= d <= len(columns)})
    score = dict.fromkeys(tried, 0.0)
    for k in range(1, n + 1):
        gram = Gram.of(df.where(_until(fold, k)), columns, y)
        if gram.n < 20:
            return base
        m, calls = np.array(gram.cov) * (gram.n - 1), []
        for d in tried:
            w = np.linalg.solve(m[:d, :d] + ridge * np.eye(d), 2 * m[:d, -1])
            line = sum((float(b) * (F.col(c) - a) for b, c, a in zip(w, columns, gram.mean, strict=False)), F.lit(2 * gram.mean[-1] - 1))
            calls += [F.count_if(line > 0).alias(f"n{d}"), F.count_if((line > 0) & (F.col(y) == 1)).alias(f"w{d}")]
        r = df.where(F.col(fold) == k).agg(*calls).first()
        for d in tried:
            trades, wins = r[f"n{d}"], r[f"w{d}"]
            score[d] += (wins * tp - (trades - wins) * sl) / trades * trades**0.5 if trades >= 5 else -1.0
    return max(tried, key=lambda d: (score[d], -d))


def by_category(importance: DataFrame, rules: Sequence[tuple[str, str]], other: str = "Other") -> DataFrame:
    """category, importance, share, features of a table (feature, importance). rules: (pattern, category), of which the first whose pattern a name has counts."""
    kind = F.coalesce(*(F.when(F.col("feature").rlike(p), c) for p, c in rules), F.lit(other))
    sums = importance.groupBy(kind.alias("category")).agg(F.sum("importance").alias("importance"), F.count(F.lit(1)).alias("features"))
    whole = sums.agg(F.sum("importance").alias("_all"))
    return sums.join(F.broadcast(whole)).select("category", "importance", F.try_divide("importance", "_all").alias("share"), "features")  # one row

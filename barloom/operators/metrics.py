"""Metrics of scored rows: confusion counts, curves, threshold searches, adaptive thresholds, bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.windows import clip, ratio


def _rates(d: DataFrame, reward: float, risk: float) -> DataFrame:
    """precision, recall, f1, accuracy, expectancy, n_trades from tp, fp, fn, tn."""
    d = d.withColumns({
        "n_trades": F.col("tp") + F.col("fp"), "precision": F.coalesce(ratio("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), "recall": F.coalesce(ratio("tp", F.col("tp") + F.col("fn")), F.lit(0.0)),
        "accuracy": F.coalesce(ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), F.lit(0.0)),
    })
    p = F.col("precision")
    return d.withColumns({
        "f1": F.coalesce(ratio(2 * p * F.col("recall"), p + F.col("recall")), F.lit(0.0)),
        "expectancy": F.when(F.col("n_trades") > 0, p * reward - (1 - p) * risk).otherwise(0.0),
    })


def _counts(said: Column, y: Column) -> list[Column]:
    return [F.count_if(c).alias(n) for n, c in (("tp", said & (y == 1)), ("fp", said & (y == 0)), ("fn", ~said & (y == 1)), ("tn", ~said & (y == 0)))]


def confusion(df: DataFrame, threshold: float = 0.55, p: str = "p", y: str = "y", by: Sequence[str] = (), reward: float = 0.02, risk: float = 0.01) -> DataFrame:
    g = df.groupBy(*by) if by else df
    return _rates(g.agg(*_counts(F.col(p) >= threshold, F.col(y))), reward, risk)


def profit_matrix(df: DataFrame, threshold: float = 0.55, p: str = "p", y: str = "y", reward: float = 0.02, risk: float = 0.01) -> DataFrame:
    d = df.agg(*_counts(F.col(p) >= threshold, F.col(y)))
    return d.withColumns({"won": F.col("tp") * reward, "lost": -F.col("fp") * risk, "net": F.col("tp") * reward - F.col("fp") * risk, "missed": F.col("fn") * reward})


def by_score(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """One row per distinct score: rows, positives. What the curves need, however many rows there are."""
    return df.groupBy(F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"))


def _cumulative(s: DataFrame, columns: Sequence[str], descending: bool = False) -> DataFrame:
    """by_score() rows with `cum_` sums of the columns up to each score. Scores (0 to 1) are summed per 1/4096 first, so no task orders all of them."""
    way = (lambda c: F.col(c).desc()) if descending else F.col
    held = s.withColumn("_b", F.floor(F.col("p") * 4096))
    before = W.orderBy(way("_b")).rowsBetween(W.unboundedPreceding, -1)  # 4097 rows at most
    sums = held.groupBy("_b").agg(*(F.sum(c).alias(c) for c in columns)).select("_b", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in columns))
    within = W.partitionBy("_b").orderBy(way("p")).rowsBetween(W.unboundedPreceding, 0)
    held = held.join(sums, "_b").withColumns({f"cum_{c}": F.sum(c).over(within) + F.col(f"_before_{c}") for c in columns})
    return held.drop("_b", *(f"_before_{c}" for c in columns))


def roc_auc(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Share of (positive, negative) pairs in order, ties half, from cumulative sums over distinct scores."""
    s = _cumulative(by_score(df, p, y).withColumn("neg", F.col("n") - F.col("pos")), ["neg"])
    s = s.withColumn("_w", F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0))
    return s.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum("_w").alias("_w")).select("positives", "negatives", ratio("_w", F.col("positives") * F.col("negatives")).alias("auc"))


def pr_curve(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    rows = by_score(df, p, y)
    s = _cumulative(rows, ["pos", "n"], descending=True).join(F.broadcast(rows.agg(F.sum("pos").alias("all"))))  # one row
    return s.select(F.col("p").alias("threshold"), ratio("cum_pos", "cum_n").alias("precision"), ratio("cum_pos", "all").alias("recall"))


def sweep(df: DataFrame, lo: int = 20, hi: int = 70, p: str = "p", y: str = "y", reward: float = 0.02, risk: float = 0.01) -> DataFrame:
    """Metrics at each threshold lo..hi percent: one pass that counts rows per step, then sums over the few steps."""
    # The highest threshold that the score reaches; by comparison, so that rounding cannot move a row.
    near = F.floor(F.col(p) * 100)
    at = F.when(F.col(p) >= (near + 1) / 100.0, near + 1).when(F.col(p) >= near / 100.0, near).otherwise(near - 1)
    reached = F.greatest(F.least(F.coalesce(at, F.lit(lo - 1)), F.lit(hi)), F.lit(lo - 1)).cast("int")
    hist = df.groupBy(reached.alias("k")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    grid = df.sparkSession.range(lo - 1, hi + 1).select(F.col("id").cast("int").alias("k"))
    up, down = W.orderBy("k").rowsBetween(0, W.unboundedFollowing), W.orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    d = grid.join(F.broadcast(hist), "k", "left").fillna(0, ["pos", "neg"])  # hist: hi - lo + 2 rows at most
    zero = lambda c: F.coalesce(c, F.lit(0))
    d = d.withColumns({"tp": F.sum("pos").over(up), "fp": F.sum("neg").over(up), "fn": zero(F.sum("pos").over(down)), "tn": zero(F.sum("neg").over(down))}).where(F.col("k") >= lo)
    d = _rates(d.withColumn("threshold", F.col("k") / 100.0), reward, risk)
    return d.withColumn("sharpe_proxy", sharpe_proxy(F.col("precision"), F.col("n_trades"), reward, risk)).drop("k", "pos", "neg")


def sharpe_proxy(precision: Column, n: Column, reward: float, risk: float) -> Column:
    """Expectancy over the deviation of outcomes, times sqrt(n); the deviation of two outcomes is sqrt(p (1 - p)) of their span."""
    spread = F.sqrt(precision * (1 - precision)) * (reward + risk)
    return F.coalesce(ratio((precision * reward - (1 - precision) * risk) * F.sqrt(n), spread), F.lit(0.0))


def constrained(swept: DataFrame, trades: int = 300, recall: float = 0.03) -> DataFrame:
    """The threshold of the best expectancy * sqrt(trades), among those with enough trades and recall if there are any."""
    ok = (F.col("n_trades") >= trades) & (F.col("recall") >= recall)
    d = swept.withColumns({"score": F.col("expectancy") * F.sqrt("n_trades"), "feasible": ok})
    return d.orderBy(F.col("feasible").desc(), F.col("score").desc(), "threshold").limit(1)


def adaptive_threshold(theta: Column, base: float, sensitivity: float, most: float, least: float = 0.5) -> Column:
    return F.greatest(F.lit(base) - F.lit(sensitivity) * clip(theta, 0.0, most) / most, F.lit(least))


def adaptive_grid(df: DataFrame, bases: Sequence[float], sensitivities: Sequence[float], most: float, p: str = "p", y: str = "y", theta: str = "theta", reward: float = 0.02, risk: float = 0.01) -> DataFrame:
    """Expectancy * ln(trades + 1) of every base and sensitivity. All counts are taken in one pass, as columns."""
    pairs = [(b, s) for b in bases for s in sensitivities]
    counts = []
    for k, (b, s) in enumerate(pairs):
        said = F.col(p) >= adaptive_threshold(F.col(theta), b, s, most)
        counts += [F.count_if(said & (F.col(y) == 1)).alias(f"tp_{k}"), F.count_if(said).alias(f"n_{k}")]
    one = df.agg(*counts)
    rows = F.explode(F.array(*(F.struct(F.lit(float(b)).alias("base"), F.lit(float(s)).alias("sensitivity"), F.col(f"tp_{k}").alias("tp"), F.col(f"n_{k}").alias("n_trades")) for k, (b, s) in enumerate(pairs))))
    d = one.select(rows.alias("r")).select("r.*").withColumn("precision", F.coalesce(ratio("tp", "n_trades"), F.lit(0.0)))
    d = d.withColumn("expectancy", F.when(F.col("n_trades") > 0, F.col("precision") * reward - (1 - F.col("precision")) * risk).otherwise(0.0))
    return d.withColumn("score", F.col("expectancy") * F.ln(F.col("n_trades") + 1))


def bootstrap(df: DataFrame, replicates: int = 50, threshold: float = 0.55, key: str = "id", p: str = "p", y: str = "y", seed: int = 42, reward: float = 0.02, risk: float = 0.01) -> DataFrame:
    """Mean, 5 % and 95 % of precision, recall and expectancy over Poisson replicates.

    A row's weight in a replicate is a Poisson(1) number from eight hex digits of an MD5 of its key, four replicates to a
    digest, so rows stay where they are: a task sends a row of sums per outcome.
    """
    marks, total, term = [], 0.0, 2.718281828459045**-1
    for k in range(1, 8):
        total += term
        marks.append(f"{int(total * (1 << 32)):08x}")
        term /= k
    said = F.when(F.col(p) >= threshold, F.when(F.col(y) == 1, "tp").when(F.col(y) == 0, "fp")).when(F.col(y) == 1, "fn").when(F.col(y) == 0, "tn")
    digests = [F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}:{k}")).cast("binary")).alias(f"_h{k}") for k in range(-(-replicates // 4))]
    rows = df.select(said.alias("_s"), *digests).where("_s IS NOT NULL")

    def weight(r: int) -> Column:
        digits, out = F.substring(f"_h{r // 4}", 8 * (r % 4) + 1, 8), None
        for k, mark in enumerate(marks):
            out = F.when(digits < mark, k) if out is None else out.when(digits < mark, k)
        return out.otherwise(len(marks))

    sums = rows.groupBy("_s").agg(*(F.sum(weight(r)).alias(f"w{r}") for r in range(replicates)))
    sums = sums.select("_s", F.posexplode(F.array(*(f"w{r}" for r in range(replicates)))).alias("replicate", "_w"))
    counts = sums.groupBy("replicate").agg(*(F.coalesce(F.sum(F.when(F.col("_s") == n, F.col("_w"))), F.lit(0)).alias(n) for n in ("tp", "fp", "fn", "tn")))
    d = _rates(counts, reward, risk)
    long = d.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("precision", "recall", "expectancy")))).alias("m")).select("m.*")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.percentile("v", F.lit(0.05)).alias("p5"), F.percentile("v", F.lit(0.95)).alias("p95"))

"""Queries on labels, splits, metrics and thresholds. Probabilities are a fixed function of the rows, so SQL can follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import labels, metrics, rolling
from barloom.operators.indicators import atr
from barloom.plans.base import BARS, KEY, Book, lag, lead, pick, roll, steps

q = Book()
QUERIES, ORACLES = q.queries, q.oracles


def hits(up: str, down: str, n: int) -> tuple[str, ...]:
    """Steps that add tp_at, sl_at and ahead."""
    f = f"OVER ({KEY} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"
    return (
        f"list(high) {f} AS hs, list(low) {f} AS ls, count(*) {f} AS ahead, {up} AS up, {down} AS dn",
        "list_min(list_filter(list_transform(hs, lambda x, k: CASE WHEN x >= up THEN k END), lambda k: k IS NOT NULL)) AS tp_at, list_min(list_filter(list_transform(ls, lambda x, k: CASE WHEN x <= dn THEN k END), lambda k: k IS NOT NULL)) AS sl_at",
    )


def won(n: int) -> str:
    return f"CASE WHEN ahead >= {n} THEN (tp_at IS NOT NULL AND (sl_at IS NULL OR tp_at < sl_at))::INT END"


@q.on_bars("fwd_ret label", steps(f"{lead('close', 4)} / nullif(close, 0) - 1 AS f", out="f AS fwd_ret; =CASE WHEN f IS NOT NULL THEN (f > 0.15)::INT END AS label"))
def label_forward(b):
    return labels.forward_return(b, 4, 0.15)


@q.on_bars("tp_at sl_at label", steps(*hits("close * (1 + 2.0::DOUBLE)", "close * (1 - 0.5::DOUBLE)", 36), out=f"=tp_at; =sl_at; ={won(36)} AS label"))
def label_triple_barrier(b):
    return labels.triple_barrier(b, 2.0, 0.5)


TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr"


@q.on_bars("label", steps(TR, f"{roll('avg', 'tr', 14)} AS atr", *hits("close + 2.5 * atr", "close - 1.0 * atr", 36), out=f"=CASE WHEN atr IS NULL THEN NULL WHEN atr < 0.001 * close AND ahead >= 36 THEN 0 ELSE {won(36)} END AS label"))
def label_atr_barrier(b):
    return labels.atr_barrier(atr(b))


@q.on_bars("exit_at mfe mae", steps(*hits("close * (1 + 2.0::DOUBLE)", "close * (1 - 0.5::DOUBLE)", 12), "least(tp_at, sl_at, ahead) AS e", out="=e::INT AS exit_at; CASE WHEN ahead > 0 THEN list_max(hs[1:greatest(e, 1)]) / close - 1 END AS mfe; CASE WHEN ahead > 0 THEN list_min(ls[1:greatest(e, 1)]) / close - 1 END AS mae"))
def mae_mfe(b):
    return labels.excursions(b, 2.0, 0.5, 12)


@q.on_bars("weight", steps(f"abs({lead('close')} / nullif(close, 0) - 1) AS a", "max(a) OVER (PARTITION BY asset) AS top", out="0.5 + 1.5 * coalesce(a / nullif(top, 0), 0) AS weight"))
def sample_weights(b):
    return labels.return_weights(b)


@q.on_bars("weight", steps("close < open AS warning, least(volume / 10, 1) AS energy", out="CASE WHEN warning THEN 0.1 ELSE 1.0 END * (1 + energy) AS weight"))
def physics_weights(b):
    return labels.physics_weights(b.withColumns({"warning": F.col("close") < F.col("open"), "energy": F.least(F.col("volume") / 10, F.lit(1.0))}), on_warning=0.1)


_order = f"WITH {BARS}, o AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS place, count(*) OVER () AS total FROM (SELECT DISTINCT ts FROM bars))"
_fold = "f AS (SELECT asset, bars.ts, CASE WHEN place >= total - 5 * (total // 6) THEN (place - (total - 5 * (total // 6))) // (total // 6) + 1 END AS fold FROM bars JOIN o ON bars.ts = o.ts)"


@q.on_bars("fold", f"{_order}, {_fold} SELECT asset, ts, fold::INT AS fold FROM f")
def ts_split_folds(b):
    return labels.folds(b)


@q.on_bars("train_rows val_rows train_end val_start val_end leaks", f"""{_order}, {_fold}, g AS (SELECT coalesce(fold, 0)::INT AS fold, count(*) AS n, min(ts) AS a, max(ts) AS z FROM f GROUP BY 1)
SELECT fold, sum(n) OVER w AS train_rows, n AS val_rows, max(z) OVER w AS train_end, a AS val_start, z AS val_end, a <= max(z) OVER w AS leaks FROM g WINDOW w AS (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) QUALIFY fold > 0
""".replace("sum(n) OVER w AS train_rows", "(sum(n) OVER w)::BIGINT AS train_rows"), key="fold")
def leakage_check(b):
    return labels.fold_report(labels.folds(b))


@q.on_bars("holdout", f"WITH {BARS} SELECT asset, ts, ts > (SELECT max(ts) FROM bars) - INTERVAL 7 DAYS AS holdout FROM bars")
def holdout_split(b):
    return labels.holdout(b)


@q.on_bars("train", f"{_order} SELECT asset, bars.ts, place < floor(total * 0.8) AS train FROM bars JOIN o ON bars.ts = o.ts")
def share_split(b):
    return labels.share_split(b)


def _fold_sql(lo: str) -> str:
    return f"""{_order}, x AS (SELECT asset, bars.ts, place, unnest(range(0, (total - 300) // 100 + 1)) AS fold FROM bars JOIN o ON bars.ts = o.ts)
SELECT * FROM (SELECT asset, ts, fold, CASE WHEN place >= {lo} AND place < fold * 100 + 200 THEN 'train' WHEN place >= fold * 100 + 200 AND place < fold * 100 + 300 THEN 'val' END AS part FROM x) WHERE part IS NOT NULL"""


@q.on_bars("part", _fold_sql("fold * 100"), key="asset, ts, fold")
def rolling_folds(b):
    return labels.rolling_folds(b, 200, 100, 100)


@q.on_bars("part", _fold_sql("0"), key="asset, ts, fold")
def expanding_folds(b):
    return labels.rolling_folds(b, 200, 100, 100, expanding=True)


# Scores: p, y, theta and id of each event ------------------------------------------------------------------------------

SCORED = """scored AS (SELECT event_id AS id, event_type AS asset, ts, ((event_id * 7919) % 1000) / 1000.0::DOUBLE AS p,
  (((event_id * 7919) % 1000) + ((event_id * 104729) % 700) > 900)::INT AS y, ((event_id * 31) % 97) / 97.0::DOUBLE AS theta FROM events)"""


def scored(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id")
    a = F.pmod(k * 7919, F.lit(1000))
    return e.select(k.alias("id"), F.col("event_type").alias("asset"), "ts", (a / 1000.0).alias("p"), ((a + F.pmod(k * 104729, F.lit(700))) > 900).cast("int").alias("y"), (F.pmod(k * 31, F.lit(97)) / 97.0).alias("theta"))


_count = "count(*) FILTER ({s} AND y = 1) AS tp, count(*) FILTER ({s} AND y = 0) AS fp, count(*) FILTER (NOT {s} AND y = 1) AS fn, count(*) FILTER (NOT {s} AND y = 0) AS tn"
_rate = """r AS (SELECT *, tp + fp AS n_trades, coalesce(tp / nullif(tp + fp, 0), 0) AS prec, coalesce(tp / nullif(tp + fn, 0), 0) AS rec, coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0) AS acc FROM c)"""
_shown = "round(prec, 6) AS precision, round(rec, 6) AS recall, round(acc, 6) AS accuracy, round(coalesce(2 * prec * rec / nullif(prec + rec, 0), 0), 6) AS f1, round(CASE WHEN n_trades > 0 THEN prec * 0.02 - (1 - prec) * 0.01 ELSE 0 END, 6) AS expectancy"


@q(f"WITH {SCORED}, c AS (SELECT asset, {_count.format(s='p >= 0.55')} FROM scored GROUP BY asset), {_rate} SELECT asset, tp, fp, fn, tn, n_trades, {_shown} FROM r")
def confusion_metrics(spark, sf_dir):
    return pick(metrics.confusion(scored(spark, sf_dir), by=["asset"]), "tp fp fn tn n_trades precision recall accuracy f1 expectancy", "asset")


@q(f"WITH {SCORED}, c AS (SELECT {_count.format(s='p >= 0.55')} FROM scored) SELECT tp, fp, fn, tn, round(tp * 0.02::DOUBLE, 6) AS won, round(-fp * 0.01::DOUBLE, 6) AS lost, round(tp * 0.02::DOUBLE - fp * 0.01::DOUBLE, 6) AS net, round(fn * 0.02::DOUBLE, 6) AS missed FROM c")
def profit_matrix(spark, sf_dir):
    return pick(metrics.profit_matrix(scored(spark, sf_dir)), "fp fn tn won lost net missed", "tp")


@q(f"""WITH {SCORED}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS k FROM scored), s AS (SELECT count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives, sum(k) FILTER (y = 1) AS w FROM r)
SELECT positives, negatives, round((w - positives * (positives + 1) / 2.0) / (positives * negatives), 6) AS auc FROM s""")
def roc_auc(spark, sf_dir):
    return pick(metrics.roc_auc(scored(spark, sf_dir)), "negatives auc", "positives")


@q(f"""WITH {SCORED}, s AS (SELECT p, count(*) AS n, sum(y) AS pos FROM scored GROUP BY p)
SELECT p AS threshold, round(sum(pos) OVER w / sum(n) OVER w, 6) AS precision, round(sum(pos) OVER w / sum(pos) OVER (), 6) AS recall FROM s WINDOW w AS (ORDER BY p DESC)""")
def pr_curve(spark, sf_dir):
    return pick(metrics.pr_curve(scored(spark, sf_dir)), "precision recall", "threshold")


_sweep = f"""WITH {SCORED}, c AS (SELECT k / 100.0::DOUBLE AS threshold, {_count.format(s='p >= k / 100.0::DOUBLE')} FROM scored, range(20, 71) g(k) GROUP BY k), {_rate},
f AS (SELECT *, CASE WHEN n_trades > 0 THEN prec * 0.02 - (1 - prec) * 0.01 ELSE 0 END AS ex FROM r)"""


@q(f"{_sweep} SELECT threshold, tp, fp, fn, tn, n_trades, {_shown}, round(coalesce((prec * 0.02 - (1 - prec) * 0.01) * sqrt(n_trades) / nullif(sqrt(prec * (1 - prec)) * 0.03, 0), 0), 6) AS sharpe_proxy FROM f")
def threshold_sweep(spark, sf_dir):
    return pick(metrics.sweep(scored(spark, sf_dir)), "tp fp fn tn n_trades precision recall accuracy f1 expectancy sharpe_proxy", "threshold")


@q(f"{_sweep} SELECT threshold, n_trades, round(ex * sqrt(n_trades), 6) AS score, n_trades >= 300 AND rec >= 0.03 AS feasible FROM f ORDER BY feasible DESC, ex * sqrt(n_trades) DESC, threshold LIMIT 1")
def constrained_threshold(spark, sf_dir):
    return pick(metrics.constrained(metrics.sweep(scored(spark, sf_dir))), "n_trades score feasible", "threshold")


@q(f"""WITH {SCORED}, g AS (SELECT base, sens, count(*) FILTER (p >= t AND y = 1) AS tp, count(*) FILTER (p >= t) AS n_trades FROM
(SELECT *, greatest(base - sens * greatest(0.0, least(1.0, theta)) / 1.0, 0.5) AS t FROM scored, (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7]::DOUBLE[]) AS base), (SELECT unnest([0.0, 0.05, 0.1, 0.15]::DOUBLE[]) AS sens)) GROUP BY 1, 2),
r AS (SELECT *, coalesce(tp / nullif(n_trades, 0), 0) AS prec FROM g), e AS (SELECT *, CASE WHEN n_trades > 0 THEN prec * 0.02 - (1 - prec) * 0.01 ELSE 0 END AS ex FROM r)
SELECT base, sens AS sensitivity, tp, n_trades, round(prec, 6) AS precision, round(ex, 6) AS expectancy, round(ex * ln(n_trades + 1), 6) AS score FROM e""")
def adaptive_grid(spark, sf_dir):
    return pick(metrics.adaptive_grid(scored(spark, sf_dir), (0.5, 0.55, 0.6, 0.65, 0.7), (0.0, 0.05, 0.1, 0.15), 1.0), "tp n_trades precision expectancy score", "base, sensitivity")


def _poisson() -> str:
    """CASE arms of a Poisson(1) number by eight hex digits."""
    arms, total, term = [], 0.0, 2.718281828459045**-1
    for k in range(7):
        total += term
        arms.append(f"WHEN d < '{int(total * (1 << 32)):08x}' THEN {k}")
        term /= k + 1
    return f"CASE {' '.join(arms)} ELSE 7 END"


@q(f"""WITH {SCORED}, h AS (SELECT p, y, k, substr(md5(id::VARCHAR || ':42:' || (k // 4)), 8 * (k % 4) + 1, 8) AS d FROM scored, range(0, 50) g(k)),
w AS (SELECT *, {_poisson()} AS w FROM h),
c AS (SELECT k, sum(w) FILTER (p >= 0.55 AND y = 1) AS tp, sum(w) FILTER (p >= 0.55 AND y = 0) AS fp, sum(w) FILTER (p < 0.55 AND y = 1) AS fn, sum(w) FILTER (p < 0.55 AND y = 0) AS tn FROM w GROUP BY k), {_rate},
m AS (SELECT 'precision' AS metric, prec AS v FROM r UNION ALL SELECT 'recall' AS metric, rec AS v FROM r UNION ALL SELECT 'expectancy' AS metric, CASE WHEN n_trades > 0 THEN prec * 0.02 - (1 - prec) * 0.01 ELSE 0 END AS v FROM r)
SELECT metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.95), 6) AS p95 FROM m GROUP BY 1""")
def bootstrap_metrics(spark, sf_dir):
    return pick(metrics.bootstrap(scored(spark, sf_dir)), "mean p5 p95", "metric")


@q(f"WITH {SCORED} SELECT asset, count(*) AS n, round(avg(p), 6) AS mean_p, round(stddev_samp(p), 6) AS std_p, arg_max(id, (p, id)) AS best FROM scored GROUP BY asset")
def group_rollup(spark, sf_dir):
    d = scored(spark, sf_dir).groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.stddev_samp("p").alias("std_p"), F.max_by("id", F.struct("p", "id")).alias("best"))
    return pick(d, "n mean_p std_p best", "asset")


@q.on_bars("n", f"WITH {BARS}, s AS (SELECT asset, ts, CASE WHEN close > open THEN 'Bull' WHEN close < open THEN 'Bear' ELSE 'Neutral' END AS state FROM bars) SELECT asset, state, count(*) AS n FROM s GROUP BY 1, 2", key="asset, state")
def state_counts(b):
    return b.withColumn("state", F.when(F.col("close") > F.col("open"), "Bull").when(F.col("close") < F.col("open"), "Bear").otherwise("Neutral")).groupBy("asset", "state").agg(F.count(F.lit(1)).alias("n"))


@q.on_bars("a b corr", f"""WITH {BARS}, r AS (SELECT asset, ts, close - {lag('close')} AS d FROM bars), p AS (SELECT x.asset AS a, y.asset AS b, x.d AS u, y.d AS v FROM r x JOIN r y ON x.ts = y.ts AND x.asset < y.asset WHERE x.d IS NOT NULL AND y.d IS NOT NULL)
SELECT a, b, count(*) AS n, round(covar_pop(u, v) / nullif(stddev_pop(u) * stddev_pop(v), 0), 6) AS corr FROM p GROUP BY 1, 2""", key="n")
def pair_corr(b):
    from barloom.operators.panel import pair_correlations

    return pair_correlations(rolling.returns(b).select("asset", "ts", F.col("diff").alias("x")))


_f = f"WITH {BARS}, r AS (SELECT *, (close - {lag('close')}) / nullif({lag('close')}, 0) AS x FROM bars), m AS (SELECT ts, avg(x) AS mean, sum(x * volume) / nullif(sum(volume) FILTER (x IS NOT NULL), 0) AS weighted FROM r GROUP BY ts)"
_zf = "round(({c} - avg({c}) OVER ()) / (stddev_samp({c}) OVER () + 1e-8), 6)"


@q.on_bars("mean weighted", f"{_f} SELECT ts, {_zf.format(c='mean')} AS mean, {_zf.format(c='weighted')} AS weighted FROM m", key="ts")
def factor_weighted_mean(b):
    from barloom.operators.panel import market_factor

    return market_factor(rolling.returns(b).select("asset", "ts", F.col("pct_ret").alias("x"), "volume"))


@q.on_bars("z", f"WITH {BARS} SELECT asset, ts, round((close - avg(close) OVER (PARTITION BY asset)) / nullif(stddev_samp(close) OVER (PARTITION BY asset), 0), 6) AS z FROM bars")
def asset_zscore(b):
    from barloom.operators.panel import standardise

    return standardise(b, ["close"]).withColumnRenamed("close_z", "z")

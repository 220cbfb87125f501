"""Queries on regimes, experts, gating, selection, clusters, neighbours and streams. Fitted models have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.storage import written
from barloom.functions.windows import chunked, ratio
from barloom.operators import batches, ensemble, graph, joins, labels, neighbours, panel, profiler, regimes, rolling, selection, temporal
from barloom.operators.indicators import rsi, sma
from barloom.plans.base import BARS, KEY, Book, lag, pick, roll, scratch, steps
from barloom.plans.features import RSI, ema_sql
from barloom.plans.scoring import SCORED, scored
from barloom.sources.bars import event_bars

q = Book()
QUERIES, ORACLES = q.queries, q.oracles

STATE = (f"ln(close / {lag('close')}) AS log_ret", f"{roll('stddev_samp', 'log_ret', 6)} AS vol", "CASE WHEN volume >= 5 THEN 0 WHEN close > open THEN 1 ELSE 2 END AS state")


def _with_state(b):
    d = rolling.deviation(rolling.returns(b), "log_ret", 6, "vol")
    return d.withColumns({"state": F.when(F.col("volume") >= 5, 0).when(F.col("close") > F.col("open"), 1).otherwise(2)})


# Regimes -----------------------------------------------------------------------------------------------------------

_g = "g AS (SELECT asset, state, count(*) AS n, avg(log_ret) AS r, avg(vol) AS v FROM x GROUP BY 1, 2)"


@q.on_bars("n mean_ret mean_vol type", "WITH x AS (" + steps(*STATE, out="=log_ret; =vol; =state") + f"), {_g}, m AS (SELECT *, median(v) OVER (PARTITION BY asset) AS mid FROM g) SELECT asset, state, n, round(r, 6) AS mean_ret, round(v, 6) AS mean_vol, CASE WHEN r > 0 THEN CASE WHEN v > mid THEN 'volatile up' ELSE 'calm up' END ELSE CASE WHEN v > mid THEN 'volatile down' ELSE 'calm down' END END AS type FROM m", key="asset, state")
def regime_typing(b):
    return regimes.typing(_with_state(b))


@q.on_bars("state regime", "WITH x AS (" + steps(*STATE, out="=log_ret; =vol; =state") + f"), {_g}, t AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY v DESC, state) AS top FROM g), u AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY top = 1, abs(r) DESC, state) AS second FROM t) SELECT x.asset, ts, x.state, CASE WHEN top = 1 THEN 'Stress' WHEN second = 1 THEN 'Trend' ELSE 'Range' END AS regime FROM x JOIN u ON x.asset = u.asset AND x.state = u.state")
def regime_names(b):
    return regimes.name_states(_with_state(b))


@q.on_bars("share_a share_b distance", "WITH x AS (" + steps(*STATE, out="=log_ret; =state") + """), g AS (SELECT asset, state, count(*) AS n, avg(log_ret) AS m, var_samp(log_ret) AS v FROM x GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY asset) AS share FROM g)
SELECT a.asset, a.state AS state_a, b.state AS state_b, round(a.share, 6) AS share_a, round(b.share, 6) AS share_b, round((a.m - b.m)**2 / nullif(4 * (a.v + b.v), 0) + 0.5 * ln((a.v + b.v) / nullif(2 * sqrt(a.v * b.v), 0)), 6) AS distance FROM s a JOIN s b ON a.asset = b.asset AND a.state < b.state""", key="asset, state_a, state_b")
def regime_separation(b):
    return regimes.separation(_with_state(b))


@q()
def hmm_regimes(spark, sf_dir):
    """Three-state model of returns and volatility, its states named; the features are clipped to tame the events' prices."""
    d = _with_state(event_bars(spark, sf_dir)).drop("state")
    model = regimes.fit(d, ["log_ret", "vol"])
    return regimes.name_states(regimes.states(d, model, ["log_ret", "vol"]))


@q()
def hmm_single(spark, sf_dir):
    """Two-state model of returns alone."""
    d = rolling.returns(event_bars(spark, sf_dir))
    return regimes.states(d, regimes.fit(d, ["log_ret"], states=2), ["log_ret"])


@q()
def hmm_consensus(spark, sf_dir):
    """Where models of four-hourly, hourly and half-hourly returns all say up, or all down."""
    frames = []
    for length in ("30 minutes", "1 hour", "4 hours"):
        d = rolling.returns(event_bars(spark, sf_dir, length))
        frames.append((regimes.sides(regimes.states(d, regimes.fit(d, ["log_ret"], rounds=50, tol=1e-4), ["log_ret"])), length))
    return regimes.consensus(frames)


# Experts, oracle, gate, blend --------------------------------------------------------------------------------------

_exp = "e AS (SELECT *, p AS p1, theta AS p2, 0.5::DOUBLE AS p3 FROM scored)"
_ce = lambda p: f"-CASE WHEN y = 1 THEN ln(greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, {p}))) ELSE ln(1 - greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, {p}))) END"


def _experts(spark, sf_dir):
    return scored(spark, sf_dir).withColumns({"p1": F.col("p"), "p2": F.col("theta"), "p3": F.lit(0.5)})


@q(f"WITH {SCORED}, {_exp}, l AS (SELECT *, {_ce('p1')} AS l1, {_ce('p2')} AS l2, {_ce('p3')} AS l3 FROM e) SELECT id, round(least(l1, l2, l3), 6) AS oracle_loss, CASE WHEN least(l1, l2, l3) > 0.8 THEN 2 WHEN l1 <= l2 AND l1 <= l3 THEN 0 WHEN l2 <= l3 THEN 1 ELSE 2 END AS oracle FROM l")
def oracle_expert(spark, sf_dir):
    return pick(ensemble.oracle_target(_experts(spark, sf_dir), ["p1", "p2", "p3"]), "oracle_loss oracle", "id")


def _gated(spark, sf_dir):
    return _experts(spark, sf_dir).withColumn("p2", F.when(F.col("id") % 5 != 0, F.col("p2"))).withColumn("gate", F.array(0.2 + F.col("p") / 3, F.lit(0.3), 0.5 - F.col("p") / 3))


_bl = "b AS (SELECT *, CASE WHEN id % 5 <> 0 THEN p2 END AS q2, 0.2 + p / 3 AS g1, 0.3::DOUBLE AS g2, 0.5 - p / 3 AS g3 FROM e)"


@q(f"WITH {SCORED}, {_exp}, {_bl} SELECT id, round((g1 * p1 + g2 * coalesce(q2, 0) + g3 * p3) / (g1 + CASE WHEN q2 IS NULL THEN 0 ELSE g2 END + g3), 6) AS p_blend FROM b")
def ensemble_blend(spark, sf_dir):
    return pick(ensemble.blend(_gated(spark, sf_dir), ["p1", "p2", "p3"]), "p_blend", "id")


@q(f"WITH {SCORED}, {_exp}, {_bl} SELECT asset, round(avg(g1), 6) AS weight_p1, round(avg(g2), 6) AS weight_p2, round(avg(g3), 6) AS weight_p3, round(avg(p1), 6) AS mean_p1, round(avg(q2), 6) AS mean_p2, round(avg(p3), 6) AS mean_p3 FROM b GROUP BY asset")
def ensemble_telemetry(spark, sf_dir):
    return pick(ensemble.telemetry(_gated(spark, sf_dir), ["p1", "p2", "p3"]), "weight_p1 weight_p2 weight_p3 mean_p1 mean_p2 mean_p3", "asset")


@q(f"WITH {SCORED} SELECT id, CASE WHEN id % 3 - 1 <> 0 AND p > 0.55 THEN id % 3 - 1 ELSE 0 END AS meta_side FROM scored")
def meta_labels(spark, sf_dir):
    return pick(ensemble.meta_filter(scored(spark, sf_dir).withColumn("side", F.col("id") % 3 - 1)), "meta_side", "id")


@q.on_bars("p_ou", steps(f"(close - {roll('avg', 'close', 20)}) / nullif({roll('stddev_samp', 'close', 20)}, 0) AS z, ln(close / {lag('close')}) AS r", f"{roll('stddev_samp', 'r', 20)} AS v", out="greatest(0.01::DOUBLE, least(0.99::DOUBLE, 0.5 + (1 / (1 + exp(greatest(-50, least(50, z)))) - 0.5) / (1 + v))) AS p_ou", where="z IS NOT NULL AND v IS NOT NULL"))
def ou_expert(b):
    d = rolling.deviation(rolling.zscore(rolling.returns(b), name="z"), "log_ret", 20, "v").where("z IS NOT NULL AND v IS NOT NULL")
    return ensemble.ou_expert(d, "z", "v")


@q.on_bars("depth retrain", steps("volume / 10 AS e, least(volume / 20, 1) AS v, (close - open) / open AS perf", out="=round(3 + 5 * greatest(0.0, least(1.0, e / 4)) * (1 - greatest(0.0, least(1.0, v)) / 2))::INT AS depth; =perf <= -0.2 AS retrain"))
def training_plan(b):
    return ensemble.training_plan(b.withColumns({"e": F.col("volume") / 10, "v": F.least(F.col("volume") / 20, F.lit(1.0)), "perf": (F.col("close") - F.col("open")) / F.col("open")}), "e", "v", "perf")


@q.on_bars("n first last", steps(f"list(close) OVER ({KEY} ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS l", out="=CASE WHEN len(l) = 16 THEN 16 END AS n; CASE WHEN len(l) = 16 THEN l[1] END AS first; CASE WHEN len(l) = 16 THEN l[16] END AS last"))
def sequence_windows(b):
    d = ensemble.windows_of(b, ["close", "volume"], 16)
    s = F.col("sequence")
    return d.select("asset", "ts", F.when(s.isNotNull(), F.size(s)).alias("n"), s[0][0].alias("first"), s[15][0].alias("last"))


FEATURES = ["rsi_14", "dist", "vol", "pct_ret", "log_range"]


def _learning(spark, sf_dir):
    """Features and labels of the bars; the last fifth of the times is for validation. Written once, as fits read them many times."""

    def work(d, keys):
        d = rsi(sma(rolling.returns(d, by=keys), by=keys), by=keys).withColumn("dist", F.col("close") / F.col("sma_20") - 1)
        return labels.forward_return(rolling.deviation(d, "log_ret", 20, "vol", by=keys), 4, 0.15, by=keys)

    b = chunked(event_bars(spark, sf_dir), work, 40, ahead=4)
    d = labels.share_split(b.withColumn("y", F.col("label").cast("double"))).dropna(subset=[*FEATURES, "y"])
    d = d.withColumn("id", F.xxhash64("asset", "ts"))
    at = scratch(spark)
    d.select("id", "asset", "ts", "train", "y", *FEATURES).write.parquet(at)
    return ensemble.assemble(spark.read.parquet(at), FEATURES)


def _fitted(name, make):
    def query(spark, sf_dir):
        d = _learning(spark, sf_dir)
        return make(d.where("train"))(d.where("NOT train")).select("asset", "ts", "y", name)

    return query


QUERIES["trend_expert"] = _fitted("p_trend", lambda t: ensemble.trend_expert(t, asset="asset"))
QUERIES["stress_expert"] = _fitted("p_stress", ensemble.stress_expert)
QUERIES["forest_model"] = _fitted("p_forest", lambda t: ensemble.forest(t, trees=10, depth=5))


@q()
def range_expert(spark, sf_dir):
    d = _learning(spark, sf_dir)
    return ensemble.range_expert(d.where("train"), d.where("NOT train")).select("asset", "ts", "y", "p_range")


@q()
def gated_ensemble(spark, sf_dir):
    """Trend and stress experts, oracle targets on the training rows, a gate on volatility, and the blend with its telemetry."""
    d = _learning(spark, sf_dir)
    train = d.where("train")
    trend, stress = ensemble.trend_expert(train), ensemble.stress_expert(train)
    ou = lambda x: ensemble.ou_expert(x, "dist", "vol")
    names = ["p_trend", "p_stress", "p_ou"]
    both = ou(stress(trend(d)))
    gate = ensemble.gate(ensemble.oracle_target(both.where("train"), names), ["vol", "log_range"], len(names))
    return ensemble.blend(gate(both.where("NOT train")), names).select("asset", "ts", "y", *names, "p_blend")


@q()
def meta_model(spark, sf_dir):
    """A first model that buys below an RSI of 50, and the second one's chance of a win and what it lets through."""
    d = _learning(spark, sf_dir).withColumn("side", F.when(F.col("rsi_14") < 50, 1).otherwise(0))
    model = ensemble.meta_model(d.where("train"), FEATURES, cross=["vol"])
    return ensemble.meta_filter(model(d.where("NOT train")), "p_meta").select("asset", "ts", "side", "p_meta", "meta_side")


@q()
def random_search(spark, sf_dir):
    d = _learning(spark, sf_dir)
    return spark.createDataFrame(ensemble.random_search(d.where("train"), d.where("NOT train")), "depth INT, rounds INT, auc DOUBLE, gap DOUBLE")


# Selection, latents, clusters ----------------------------------------------------------------------------------------


@q()
def alpha_council(spark, sf_dir):
    """Feature, cluster, mutual information, and whether the correlation filter, the leaders and the greedy search keep it."""
    d = _learning(spark, sf_dir)
    own, mi = selection.clusters(d, FEATURES), {r.feature: r.mi for r in selection.mutual_information(d, FEATURES, "y").collect()}
    kept, lead = selection.correlated(d, FEATURES, "y"), selection.leaders(d, FEATURES)
    greedy = selection.greedy(selection.Gram.of(d, FEATURES, "y"), least=2)
    return spark.createDataFrame([(f, own[f], mi.get(f), f in kept, f in lead, f in greedy) for f in FEATURES], "feature STRING, cluster INT, mi DOUBLE, uncorrelated BOOLEAN, leader BOOLEAN, greedy BOOLEAN")


@q()
def tensor_latents(spark, sf_dir):
    d = _learning(spark, sf_dir)
    gram = selection.Gram.of(d.where("train"), FEATURES, "y")
    model = selection.latents(gram, selection.clusters(d.where("train"), FEATURES, 0.8, linkage="average"))
    out = model.transform(d)
    return out.select("asset", "ts", *(c for c in out.columns if c.startswith("tf_")))


@q()
def feature_budget(spark, sf_dir):
    """Clusters of at most two features, and the three features that a fixed budget takes."""
    d = _learning(spark, sf_dir)
    own = selection.small_clusters(d, FEATURES, 2)
    taken = selection.budget(selection.Gram.of(d, FEATURES, "y"), own, 3)
    return spark.createDataFrame([(f, own[f], f in taken) for f in FEATURES], "feature STRING, cluster INT, taken BOOLEAN")


@q()
def latent_ranking(spark, sf_dir):
    """Each component's rank, how stable its correlation with the label is, how often an L1 model keeps it, and whether it is selected."""
    d = labels.folds(_learning(spark, sf_dir).drop("train"))
    model = selection.latents(selection.Gram.of(d, FEATURES, "y"), selection.clusters(d, FEATURES, 0.8, linkage="average"))
    wide, names = model.transform(d), sorted(model.rank)
    stable = {r.feature: r.stability for r in selection.correlation_stability(wide, names, "y").collect()}  # a row per component
    often, chosen = selection.l1_frequency(wide, names, "y"), model.select(3, stable)
    return spark.createDataFrame([(c, float(model.rank[c]), stable[c], often[c], c in chosen) for c in names], "component STRING, rank DOUBLE, stability DOUBLE, frequency DOUBLE, selected BOOLEAN")


@q()
def latent_tuning(spark, sf_dir):
    """How many components of all features are kept when two are the base."""
    d = labels.folds(_learning(spark, sf_dir).drop("train"), 2)
    model = selection.latents(selection.Gram.of(d, FEATURES, "y"), dict.fromkeys(FEATURES, 0), per_cluster=4)
    best = selection.tune_dimension(model.transform(d), [f"tf_cluster0_pc{k}" for k in range(4)], "y", 2)
    return spark.createDataFrame([(2, best)], "base INT, tuned INT")


@q()
def tensor_report(spark, sf_dir):
    """Intrinsic dimension of the features and what is taken out of each cluster."""
    import numpy as np

    d = _learning(spark, sf_dir)
    gram = selection.Gram.of(d, FEATURES, "y")
    dim = selection.intrinsic_dimension(np.array(gram.cov)[:-1, :-1], gram.n)
    out = selection.residualise(gram, selection.clusters(d, FEATURES))
    return spark.createDataFrame([*((k, float(v)) for k, v in dim.items()), *((f"residual_{c}", float(a)) for c, a in out.items())], "name STRING, value DOUBLE")


@q.on_bars("strength stability", f"""WITH {BARS}, o AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS place, count(*) OVER () AS total FROM (SELECT DISTINCT ts FROM bars)),
f AS (SELECT bars.*, (place - (total - 5 * (total // 6))) // (total // 6) + 1 AS fold FROM bars JOIN o ON bars.ts = o.ts WHERE place >= total - 5 * (total // 6)),
g AS (SELECT fold, abs(covar_pop(open, close) / nullif(stddev_pop(open) * stddev_pop(close), 0)) AS open, abs(covar_pop(volume, close) / nullif(stddev_pop(volume) * stddev_pop(close), 0)) AS volume FROM f GROUP BY 1),
l AS (SELECT 'open' AS feature, open AS r FROM g UNION ALL SELECT 'volume' AS feature, volume AS r FROM g)
SELECT feature, round(avg(r), 6) AS strength, round(1 / (1 + coalesce(stddev_samp(r) / nullif(avg(r), 0), 0)), 6) AS stability FROM l GROUP BY 1""", key="feature")
def fold_stability(b):
    return selection.fold_stability(labels.folds(b), ["open", "volume"], "close")


@q.on_bars("stability", f"""WITH {BARS}, o AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS place, count(*) OVER () AS total FROM (SELECT DISTINCT ts FROM bars)),
f AS (SELECT bars.*, CASE WHEN place >= total - 5 * (total // 6) THEN (place - (total - 5 * (total // 6))) // (total // 6) + 1 ELSE 0 END AS fold FROM bars JOIN o ON bars.ts = o.ts),
c AS (SELECT k, count(*) AS n, coalesce(corr(open, close), 0) AS open, coalesce(corr(volume, close), 0) AS volume FROM f JOIN range(1, 6) r(k) ON f.fold < r.k GROUP BY k),
l AS (SELECT 'open' AS feature, open AS r FROM c WHERE n >= 50 UNION ALL SELECT 'volume' AS feature, volume AS r FROM c WHERE n >= 50)
SELECT feature, round(CASE WHEN abs(avg(r)) >= 1e-9 THEN 1 / (1 + stddev_pop(r) / (abs(avg(r)) + 1e-6)) ELSE 0 END, 6) AS stability FROM l GROUP BY 1""", key="feature")
def correlation_stability(b):
    return selection.correlation_stability(labels.folds(b), ["open", "volume"], "close")


@q()
def factor_pca(spark, sf_dir):
    """The first principal component of assets' standardised returns, per time."""
    return panel.pca_factor(rolling.returns(event_bars(spark, sf_dir)).select("asset", "ts", F.col("diff").alias("x")))


@q()
def asset_clusters(spark, sf_dir):
    return panel.cluster_assets(rolling.returns(event_bars(spark, sf_dir)).select("asset", "ts", F.col("diff").alias("x")), leader="click")


@q("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT q.vec_id AS id, e.vec_id AS neighbour, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS distance FROM q JOIN embeddings e ON q.vec_id <> e.vec_id)
SELECT id, neighbour, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM d) WHERE rank <= 15""")
def knn_exact(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return pick(neighbours.nearest(e.where("id % 100 = 0"), e), "distance rank", "id, neighbour")


@q(f"""SELECT event_type AS asset, time_bucket(INTERVAL 5 MINUTES, events.ts) AS ts, first(value ORDER BY events.ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY events.ts, event_id) AS close, count(*)::DOUBLE AS volume
FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 5 MINUTES, any_value(events.ts)) + INTERVAL 5 MINUTES <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""".replace("GROUP BY 1, 2", "GROUP BY 1, time_bucket(INTERVAL 5 MINUTES, events.ts)"))
def streaming_bars(spark, sf_dir):
    """Five-minute bars of the events as a stream; a bar is written once the watermark has passed its end."""
    from barloom.streaming import live

    sink = scratch(spark)
    live.run(live.stream_bars(live.ticks(spark, sf_dir, "events.parquet")), sink, scratch(spark)).awaitTermination()
    b = spark.read.parquet(sink)
    return b.select("asset", F.expr("to_timestamp_ntz(date_format(ts, 'yyyy-MM-dd HH:mm:ss'))").alias("ts"), "open", "high", "low", "close", "volume")


_DONE = "ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES"
_STREAM = steps(*RSI, f"coalesce(sign(close - {lag('close')}) * volume, 0) AS signed", f"sum(signed) OVER ({KEY}) AS obv, CASE WHEN rsi_14 < 40 THEN 1 WHEN rsi_14 > 55 THEN 0 END AS event", f"coalesce(last_value(event IGNORE NULLS) OVER ({KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS position", out="=close; =obv; =rsi_14; =position")


@q(f"WITH x AS ({_STREAM}), {ema_sql('close', 12, 'ef', 'x')}, {ema_sql('close', 26, 'es', 'ef_t')} SELECT asset, ts, round(ef, 6) AS ema_12, round(es, 6) AS ema_26, round(obv, 6) AS obv, round(rsi_14, 6) AS rsi_14, position FROM es_t WHERE {_DONE}")
def streaming_indicators(spark, sf_dir):
    """Averages, OBV, RSI and position of hourly bars of a stream, from state that is kept per asset."""
    from barloom.streaming import live, state

    sink = scratch(spark)
    bars = live.stream_bars(live.ticks(spark, sf_dir, "events.parquet"), every="1 hour")
    live.run(state.indicators(bars, "1 hour", {"ema_12": 12, "ema_26": 26}, buy=40, sell=55), sink, scratch(spark)).awaitTermination()
    return pick(live.plain_time(spark.read.parquet(sink)), "ema_12 ema_26 obv rsi_14 position")


@q()
def live_decisions(spark, sf_dir):
    """Long, short or flat of each half-hourly bar of a stream: where filtered states of three frames' models agree."""
    from barloom.streaming import live, state

    frames = []
    for length in ("30 minutes", "1 hour", "4 hours"):
        history = rolling.returns(event_bars(spark, sf_dir, length))
        stream = live.stream_bars(live.ticks(spark, sf_dir, "events.parquet"), every=length)
        frames.append((stream, length, regimes.fit(history, ["log_ret"], rounds=5)))
    sink = scratch(spark)
    live.run(state.decisions(frames), sink, scratch(spark), score=live.named).awaitTermination()
    return live.plain_time(spark.read.parquet(sink)).drop("batch")


# Clusters that are residualised, models that choose features, networks ---------------------------------------------------

_TALK = f"""WITH {BARS}, a AS (SELECT *, avg(open) OVER () AS mo, avg(close) OVER () AS mc, avg(volume) OVER () AS mv FROM bars), s1 AS (SELECT covar_samp(close, open) / var_samp(open) AS k FROM bars),
b AS (SELECT *, close - 0.5::DOUBLE * k * (open - mo) AS tc FROM a, s1), s2 AS (SELECT covar_samp(volume, tc) / var_samp(tc) AS j FROM b)
SELECT asset, ts, round(open, 6) AS tt_open, round(tc, 6) AS tt_close, round(volume - j * (tc - mc), 6) AS tt_volume FROM b, s2"""


@q.on_bars("tt_open tt_close tt_volume", _TALK)
def tensor_talk(b):
    """Half of what opens say of closes is taken out of closes, and then all that the rest says of volumes out of volumes."""
    gram = selection.Gram.of(b, ["open", "close", "volume"], "high")
    return selection.tensor_talk(gram, {"open": 0, "close": 1, "volume": 2}, fixed=[(0, 1, 0.5), (1, 2, 1.0)])[0].transform(b)


@q()
def talking_latents(spark, sf_dir):
    """Components of clusters that no longer repeat each other."""
    d = _learning(spark, sf_dir)
    own = selection.clusters(d.where("train"), FEATURES, 0.8, linkage="average")
    talk, gram = selection.tensor_talk(selection.Gram.of(d.where("train"), FEATURES, "y"), own)
    out = selection.latents(gram, own, talk=talk).transform(d)
    return out.select("asset", "ts", *(c for c in out.columns if c.startswith(("tf_", "tt_"))))


@q()
def classifier_selection(spark, sf_dir):
    """Features in the order in which a logistic model of the label takes them, with what each adds to it."""
    taken = selection.greedy_classifier(_learning(spark, sf_dir).where("train"), FEATURES, "y", least=2)
    return spark.createDataFrame([(k, f, g) for k, (f, g) in enumerate(taken)], "step INT, feature STRING, gain DOUBLE")


_SETS = "('click', 'view', 'purchase')"


@q(f"""WITH {BARS}, w AS (SELECT ts, max(close) FILTER (asset = 'click') AS a, max(close) FILTER (asset = 'view') AS b, max(close) FILTER (asset = 'purchase') AS c FROM bars WHERE asset IN {_SETS} GROUP BY ts HAVING count(DISTINCT asset) = 3),
l AS (SELECT ts, list([a, b, c]) OVER (ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS s FROM w), o AS (SELECT *, row_number() OVER (ORDER BY md5('7:' || strftime(ts, '%Y-%m-%d %H:%M:%S'))) - 1 AS n, count(*) OVER () AS total FROM l WHERE len(s) = 8)
SELECT ts, n // 32 AS batch, (n % 32)::INT AS place, round(s[1][1], 6) AS first, round(s[8][3], 6) AS last FROM o WHERE n < total - total % 32""")
def intersection_batches(spark, sf_dir):
    """Windows of eight times that three assets have in common, as shuffled batches of 32."""
    d = batches.intersection_windows(event_bars(spark, sf_dir), "close", ["click", "view", "purchase"], 8, every="30 days")
    d = batches.shuffled_batches(d, ["ts"], 32).select("ts", "batch", "place", F.col("sequence")[0][0].alias("first"), F.col("sequence")[7][2].alias("last"))
    return pick(d, "batch place first last", "ts")


@q()
def temporal_cnn(spark, sf_dir):
    """Probabilities of a rise from the last 16 rows of features, by a network trained on the training rows."""
    d = ensemble.windows_of(_learning(spark, sf_dir).drop("features"), FEATURES, 16)
    model = temporal.fit(d.where("train"), ["asset", "ts"], rounds=10)
    return model(d).select("asset", "ts", "train", "y", "p_temporal")


@q()
def graph_expert(spark, sf_dir):
    """Probabilities of a rise of each asset from the features of all assets of its time, and whom it looks at."""
    d = _learning(spark, sf_dir).drop("features")
    model = graph.fit(d.where("train"), ["click", "error", "purchase", "signup", "view"], FEATURES, rounds=10)
    return model(d)


# Profiles, panels with gaps, dominant assets, categories ------------------------------------------------------------------

_MEASURED = "volume / 9 AS hurst, (close - low) / nullif(high - low, 0) / 5 AS theta, volume / 2 AS entropy, open / nullif(high, 0) AS fracdiff_corr, abs(close - open) AS vol_of_vol"
_PROFILED = f"WITH {BARS}, x AS (SELECT asset, ts, {_MEASURED} FROM bars), l AS (UNPIVOT x ON hurst, theta, entropy, fracdiff_corr, vol_of_vol INTO NAME metric VALUE v), p AS (SELECT asset, metric, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, median(v) AS median FROM l GROUP BY 1, 2)"


def _measured(b):
    return b.select(
        "asset", "ts", (F.col("volume") / 9).alias("hurst"), (ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low")) / 5).alias("theta"), (F.col("volume") / 2).alias("entropy"),
        ratio("open", "high").alias("fracdiff_corr"), F.abs(F.col("close") - F.col("open")).alias("vol_of_vol"),
    )


@q.on_bars("mean median verdict", f"""{_PROFILED} SELECT asset, metric, round(mean, 6) AS mean, round(median, 6) AS median, CASE metric WHEN 'hurst' THEN CASE WHEN mean > 0.55 THEN 'TRENDING' WHEN mean < 0.45 THEN 'MEAN-REVERTING' ELSE 'RANDOM WALK' END
WHEN 'theta' THEN CASE WHEN mean > 0.1 THEN 'ELASTIC' WHEN mean > 0.01 THEN 'MODERATE' ELSE 'WEAK REVERSION' END WHEN 'entropy' THEN CASE WHEN mean > 2.5 THEN 'HIGH NOISE' WHEN mean > 1.5 THEN 'MODERATE NOISE' ELSE 'LOW NOISE' END
WHEN 'fracdiff_corr' THEN CASE WHEN mean > 0.7 THEN 'STRONG MEMORY' WHEN mean > 0.3 THEN 'MODERATE MEMORY' ELSE 'WEAK MEMORY' END ELSE CASE WHEN mean > 0 AND std / mean > 1 THEN 'EXPLOSIVE' ELSE 'STABLE' END END AS verdict FROM p""", key="asset, metric")
def profile_verdicts(b):
    """Verdicts on distributions; what the metrics are is tested elsewhere, here they are plain columns."""
    return profiler.diagnose(profiler.summary(_measured(b)))


@q.on_bars("mean_a mean_b difference percent", f"{_PROFILED} SELECT a.metric, a.asset AS asset_a, b.asset AS asset_b, round(a.mean, 6) AS mean_a, round(b.mean, 6) AS mean_b, round(a.mean - b.mean, 6) AS difference, round(100 * (a.mean - b.mean) / nullif(b.mean, 0), 6) AS percent FROM p a JOIN p b ON a.metric = b.metric AND a.asset < b.asset", key="metric, asset_a, asset_b")
def profile_pairs(b):
    return profiler.compare_all(profiler.summary(_measured(b)))


@q()
def physics_profile(spark, sf_dir):
    """Five rolling metrics of each asset's hourly bars, their distributions and verdicts."""
    return profiler.diagnose(profiler.summary(written(profiler.metrics(written(event_bars(spark, sf_dir))))))


_FIVE = ["click", "error", "purchase", "signup", "view"]


@q.on_bars(" ".join(_FIVE), f"""WITH {BARS}, w AS (SELECT ts, {', '.join(f"max(close) FILTER (asset = '{a}') AS {a}" for a in _FIVE)}, count(DISTINCT asset) AS n FROM bars GROUP BY ts),
f AS (SELECT ts, {', '.join(f'last_value({a} IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS {a}' for a in _FIVE)} FROM w WHERE n >= 2)
SELECT ts, {', '.join(f'round({a}, 6) AS {a}' for a in _FIVE)} FROM f WHERE {' AND '.join(f'{a} IS NOT NULL' for a in _FIVE)}""", key="ts")
def panel_with_gaps(b):
    return joins.outer_panel(b, "close", _FIVE)


@q.on_bars("dominant total share", f"WITH {BARS}, s AS (SELECT CASE WHEN asset < 'e' THEN 0 ELSE 1 END AS cluster, asset, sum(volume) AS total FROM bars GROUP BY asset) SELECT cluster, first(asset ORDER BY total DESC, asset) AS dominant, round(max(total), 6) AS total, round(max(total) / sum(total), 6) AS share FROM s GROUP BY cluster", key="cluster")
def dominant_assets(b):
    groups = b.select("asset", F.when(F.col("asset") < "e", 0).otherwise(1).alias("cluster")).distinct()
    return panel.dominant(b, groups)


@q.on_bars("importance share features", f"WITH {BARS}, i AS (UNPIVOT (SELECT abs(corr(open, close)) AS open, abs(corr(high, close)) AS high, abs(corr(low, close)) AS low, abs(corr(volume, close)) AS volume FROM bars) ON COLUMNS(*) INTO NAME feature VALUE v), c AS (SELECT CASE WHEN feature LIKE '%vol%' THEN 'Volume' WHEN feature IN ('open', 'high') THEN 'Price' ELSE 'Other' END AS category, sum(v) AS importance, count(*) AS features FROM i GROUP BY 1) SELECT category, round(importance, 6) AS importance, round(importance / sum(importance) OVER (), 6) AS share, features FROM c", key="category")
def category_importance(b):
    """What correlations with the close come to, by kind of feature."""
    names = ["open", "high", "low", "volume"]
    tie = lambda c: F.abs(F.try_divide(F.covar_pop(c, "close"), F.stddev_pop(c) * F.stddev_pop("close")))
    long = b.agg(*(tie(c).alias(c) for c in names)).select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in names))).alias("x")).select("x.*")
    return selection.by_category(long, [("vol", "Volume"), ("^(open|high)$", "Price")])

"""Properties of the bar operators: causality, isolation of assets, warm-up, closed forms, bounded pieces, fitted models."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import quantiles, windows
from barloom.functions.windows import Roll, chunked, ema, running_sum
from barloom.operators import accounts, ensemble, factory, joins, labels, metrics, neighbours, panel, physics, profiler, regimes, rolling, selection, trading
from barloom.operators import indicators as I
from barloom.sources import bars as B
from barloom.sources import quality


@pytest.fixture(scope="module")
def walk(spark):
    return B.synthetic(spark, 3, 400).cache()


def series(df, column, asset="A0"):
    return df.where(F.col("asset") == asset).orderBy("ts").select(column).toPandas()[column].to_numpy(float)


OPERATORS = [I.rsi, I.sma, I.bbands, I.atr, I.roc, I.cci, I.willr, I.adx, I.obv, I.cmf, I.mfi, I.slope, I.ao, I.stoch, I.donchian, I.macd, I.dist_ema, rolling.returns, rolling.zscore, rolling.fdi, rolling.hurst, lambda d: rolling.stability(d, window=20, span=60), lambda d: physics.frac_diff(d, 0.4, cut=1e-2)]


@pytest.mark.parametrize("operator", OPERATORS)
def test_features_look_back_only_and_at_their_own_asset(walk, operator):
    """Other assets and later rows do not change a row."""
    end = walk.where("asset = 'A0'").orderBy("ts").select("ts").collect()[250].ts
    some = operator(walk.where((F.col("asset") == "A0") & (F.col("ts") <= F.lit(end)))).orderBy("ts").toPandas()
    whole = operator(walk).where((F.col("asset") == "A0") & (F.col("ts") <= F.lit(end))).orderBy("ts").toPandas()
    pd.testing.assert_frame_equal(some, whole, check_exact=False, rtol=1e-9)


def test_warm_up(walk):
    d = I.sma(I.rsi(walk), (20,))
    assert np.isnan(series(d, "sma_20")).sum() == 19 and np.isnan(series(d, "rsi_14")).sum() == 13


def test_constant_and_straight_prices(spark, walk):
    flat = walk.withColumns({c: F.lit(5.0) for c in ("open", "high", "low", "close")})
    assert set(series(I.sma(flat), "sma_20")[19:]) == {5.0}
    assert set(series(rolling.hurst(flat), "hurst_100")[99:]) == {0.5}
    assert set(series(rolling.entropy(rolling.returns(flat)), "entropy_100")[100:]) == {0.0}
    assert rolling.stability(flat, window=20, span=40).where("acf IS NOT NULL OR warning").count() == 0
    line = walk.withColumn("close", Roll().number().cast("double") * 3)
    assert np.allclose(series(I.slope(line), "slope_14")[13:], 3)
    assert np.allclose(series(I.rsi(line), "rsi_14")[14:], 100, atol=1e-6)


def test_ema_is_the_recurrence(walk):
    x = pd.Series(series(walk, "close"))
    d = ema(walk, {"a": ("close", 9), "b": ("close", 200), "c": ("close", 2)}, block=16)
    for name, n in (("a", 9), ("b", 200), ("c", 2)):
        assert np.allclose(series(d, name), x.ewm(span=n, adjust=False).mean())


def test_chunks_and_buckets_change_nothing(walk):
    assert np.allclose(series(chunked(walk, lambda d, by: I.sma(d, (50,), by=by), 49, rows=60), "sma_50"), series(I.sma(walk, (50,)), "sma_50"), equal_nan=True)
    assert np.allclose(series(running_sum(walk, F.col("volume"), "s"), "s"), np.cumsum(series(walk, "volume")))


def test_frac_diff():
    w = physics.frac_weights(0.5, 0, 10)
    assert all(abs(w[k] + w[k - 1] * (0.5 - k + 1) / k) < 1e-10 for k in range(1, 10)) and len(w) == 10
    assert physics.frac_weights(1.0) == [1.0, -1.0]


def test_frac_diff_of_order_one_is_a_difference(walk):
    assert np.allclose(series(physics.frac_diff(walk, 1.0), "frac_diff")[1:], np.diff(series(walk, "close")))
    assert np.allclose(series(physics.frac_diff(walk, 0), "frac_diff"), series(walk, "close"))


def test_stationarity():
    rng = np.random.default_rng(42)
    steps = rng.standard_normal(500)
    assert physics.adf_statistic(np.cumsum(steps)) > physics.adf_limit(500) > physics.adf_statistic(steps)
    assert physics.adf_statistic(np.ones(100)) is None


def test_min_d(walk):
    got = physics.find_min_d(walk, share=1.0).collect()
    assert len(got) == 3 and all(0 <= r.min_d <= 0.65 for r in got)


def test_ou_of_a_known_process(spark):
    rng, x = np.random.default_rng(0), [0.0]
    for e in rng.standard_normal(4000):
        x.append(float(0.9 * x[-1] + e))
    df = spark.createDataFrame([("A", k, v + 50) for k, v in enumerate(x)], "asset STRING, ts LONG, close DOUBLE")
    r = physics.ou_fit(df).first()
    assert math.isclose(r.theta, -math.log(0.9), rel_tol=0.1) and math.isclose(r.mu, 50, rel_tol=0.02) and math.isclose(r.half_life, math.log(2) / r.theta)


def test_two_wells(spark):
    """The fit finds a drift of a x - b x^3 again, and its wells."""
    rng, x = np.random.default_rng(1), [0.5]
    for e in rng.standard_normal(6000):
        x.append(float(x[-1] + 0.2 * x[-1] - 0.1 * x[-1] ** 3 + 0.3 * e))
    r = physics.double_well_fit(spark.createDataFrame([("A", k, v) for k, v in enumerate(x)], "asset STRING, ts LONG, x DOUBLE"), "x").first()
    assert math.isclose(r.a, 0.2, rel_tol=0.25) and math.isclose(r.b, 0.1, rel_tol=0.25) and r.bistable and math.isclose(r.well, 2**0.5, rel_tol=0.2)


def test_simulations_are_seeded(walk):
    fits = physics.ou_fit(walk).fillna({"theta": 0.1, "mu": 100.0, "sigma": 1.0})
    a, b = (Counter(map(tuple, physics.simulate(fits.repartition(n), paths=2, steps=20).collect())) for n in (1, 4))
    assert a == b and sum(a.values()) == 3 * 2 * 20


def test_sl_wins_on_the_same_bar(spark):
    rows = [("A", 0, 100.0, 100.0, 100.0), ("A", 1, 130.0, 80.0, 100.0), ("A", 2, 100.0, 100.0, 100.0), ("A", 3, 130.0, 100.0, 100.0)]
    d = labels.triple_barrier(spark.createDataFrame(rows, "asset STRING, ts INT, high DOUBLE, low DOUBLE, close DOUBLE"), 0.2, 0.1, 2)
    assert [r.label for r in d.orderBy("ts").collect()] == [0, 1, None, None]


def test_folds_do_not_leak(walk):
    f = labels.folds(walk)
    report = labels.fold_report(f).collect()
    assert len(report) == 5 and not any(r.leaks for r in report) and all(r.val_rows == 3 * 66 for r in report)
    assert f.groupBy("ts").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert labels.folds(walk.limit(3)).count() == 3


def test_asof_limits(spark):
    left = spark.createDataFrame([("A", k) for k in range(10)], "asset STRING, t INT").selectExpr("asset", "timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, t) AS ts")
    right = spark.createDataFrame([("A", 2, 1.0), ("A", 2, 2.0), ("A", 7, None)], "asset STRING, t INT, x DOUBLE").selectExpr("asset", "timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, t) AS ts", "x")
    got = [r.x for r in joins.asof(left, right, ["x"], max_rows=3).orderBy("ts").collect()]
    assert got[:2] == [None, None] and set(got[2:5]) <= {1.0, 2.0} and got[5:] == [None] * 5
    assert joins.asof(left, right, ["x"], available="1 HOUR").where("x IS NOT NULL").count() == 5


def test_forced_entries(spark):
    """Three days of hours: only the second has no signal, so one row is forced (of equal ones the first)."""
    rng = np.random.default_rng(42)
    p = [*rng.uniform(0.6, 0.8, 24), *rng.uniform(0.3, 0.45, 22), 0.5, 0.5, *rng.uniform(0.55, 0.75, 24)]
    df = spark.createDataFrame([("A", k, float(x), 1 if x >= 0.55 else 0) for k, x in enumerate(p)], "asset STRING, t INT, p DOUBLE, signal INT").selectExpr("asset", "timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, t) AS ts", "t", "p", "signal")
    assert [r.t for r in trading.forced_entry(df).where("forced").collect()] == [46]


def test_bootstrap_is_about_the_metric(spark):
    df = spark.range(4000).select("id", (F.col("id") % 100 / 100.0).alias("p"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    m = {r.metric: r for r in metrics.bootstrap(df).collect()}
    one = metrics.confusion(df).first()
    assert all(m[k].p5 <= one[k] <= m[k].p95 and abs(m[k].mean - one[k]) < 0.02 for k in ("precision", "recall"))


def test_clusters_of_assets(spark):
    """Mixes of two trends part into two groups; the leader is alone."""
    rng = np.random.default_rng(42)
    t1, t2 = rng.standard_normal((2, 300))
    x = {"BTC": t1, "B": t1 + 0.1 * rng.standard_normal(300), "C": t1 + 0.2 * rng.standard_normal(300), "D": t2, "E": t2 + 0.1 * rng.standard_normal(300)}
    df = spark.createDataFrame([(a, k, float(v)) for a, s in x.items() for k, v in enumerate(s)], "asset STRING, ts INT, x DOUBLE")
    got = {r.asset: r.cluster for r in panel.cluster_assets(df, 3, "BTC").collect()}
    assert got["BTC"] == 0 and got["B"] == got["C"] != got["D"] == got["E"] and 0 not in (got["B"], got["D"])
    assert math.isclose({(r.a, r.b): r["corr"] for r in panel.pair_correlations(df).collect()}["B", "C"], np.corrcoef(x["B"], x["C"])[0, 1])


def test_latents(spark, tmp_path):
    """Three blocks of alike columns and noise: three clusters at least, and components that carry the target."""
    rng = np.random.default_rng(42)
    base, cols = rng.standard_normal((3, 300)), {}
    for b in range(3):
        for k in range(3):
            cols[f"c{b}_{k}"] = base[b] + 0.05 * rng.standard_normal(300)
    cols["noise"] = rng.standard_normal(300)
    cols["y"] = (base[0] + 0.5 * base[1] > 0).astype(float)
    df = spark.createDataFrame(pd.DataFrame(cols))
    names = [c for c in cols if c != "y"]
    groups = selection.clusters(df, names)
    assert len(set(groups.values())) == 4 and all(len({groups[f"c{b}_{k}"] for k in range(3)}) == 1 for b in range(3))
    gram = selection.Gram.of(df, names, "y")
    model = selection.latents(gram, groups)
    model.save(spark, str(tmp_path / "m"))
    d = selection.Latents.load(spark, str(tmp_path / "m")).transform(df).toPandas()
    assert abs(np.corrcoef(d["tf_cluster0_pc0"], base[0])[0, 1]) > 0.99 and model.selected
    assert set(selection.greedy(gram, least=1)) & {"c0_0", "c0_1", "c0_2"} and len(selection.correlated(df, names, "y")) == 4 and len(selection.leaders(df, names)) == 4
    assert selection.intrinsic_dimension(np.array(gram.cov)[:-1, :-1], gram.n)["marchenko_pastur"] == 3
    mi = {r.feature: r.mi for r in selection.mutual_information(df, names, "y").collect()}
    assert mi["c0_0"] > mi["c1_0"] > mi["c2_0"]
    assert set(selection.residualise(gram, groups)) == set(groups.values())


def test_hmm_finds_two_regimes(spark):
    rng = np.random.default_rng(3)
    truth = np.repeat([0, 1, 0, 1], 250)
    x = np.where(truth == 0, 0.0, 3.0) + rng.standard_normal(1000) * 0.5
    df = spark.createDataFrame([("A", k, float(v)) for k, v in enumerate(x)], "asset STRING, k INT, x DOUBLE").selectExpr("asset", "timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, k) AS ts", "x")
    model = regimes.fit(df, ["x"], states=2, rounds=6)
    got = regimes.states(df, model, ["x"]).orderBy("ts").toPandas().state.to_numpy()
    assert max((got == truth).mean(), (got != truth).mean()) > 0.98 and sorted(np.round(model.mean.ravel())) == [0, 3]


def test_choice_of_latents(spark):
    """Columns 0 and 1 carry the target, 2 and 3 are noise."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((600, 4))
    y = (x[:, 0] + 0.7 * x[:, 1] + 0.3 * rng.standard_normal(600) > 0).astype(float)
    df = spark.createDataFrame(pd.DataFrame({f"c{k}": x[:, k] for k in range(4)} | {"y": y, "fold": np.arange(600) // 100}))
    names = [f"c{k}" for k in range(4)]
    often = selection.l1_frequency(df, names, "y")
    assert often["c0"] == often["c1"] == 1.0 and max(often["c2"], often["c3"]) <= 0.4
    got = {r.feature: r.stability for r in selection.correlation_stability(df, names, "y").collect()}
    for k in range(4):
        r = [np.corrcoef(x[: 100 * f, k], y[: 100 * f])[0, 1] for f in range(1, 6)]
        assert math.isclose(got[f"c{k}"], 1 / (1 + np.std(r) / (abs(np.mean(r)) + 1e-6)), rel_tol=1e-6)
    thirds = df.withColumn("fold", F.floor(F.col("fold") / 2))
    assert selection.tune_dimension(thirds, names, "y", 1) == 2 and selection.tune_dimension(thirds, names, "y", 4) in (3, 4)
    gram = selection.Gram.of(df, names, "y")
    assert selection.budget(gram, {"c0": 0, "c1": 1, "c2": 2, "c3": 2}, 3)[:2] == ["c0", "c1"] and len(selection.budget(gram, {"c0": 0, "c1": 1, "c2": 2, "c3": 2}, 1)) == 1
    own = selection.small_clusters(df.withColumn("flat", F.lit(1.0)), [*names, "flat"], 2)
    assert len(own) == 5 and max(list(own.values()).count(c) for c in own.values()) <= 2 and list(own.values()).count(own["flat"]) == 1
    model = selection.latents(gram, dict.fromkeys(names, 0), per_cluster=4, keep=2)
    assert len(model.selected) == 2 and max(model.rank.values()) <= 1 and model.select(1, {model.selected[0]: 0.0}) != model.selected[1:]


def test_second_model(spark, tmp_path):
    """Trades win when x agrees with the side: the second model finds out, also after it was saved; rows keep their columns."""
    rng = np.random.default_rng(9)
    x, side = rng.standard_normal(500), rng.integers(-1, 2, 500)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "side": side, "y": (x * side > 0).astype(float)})).withColumn("x", F.when(F.col("x") < 2.5, F.col("x")))
    model = ensemble.meta_model(df, ["x"], cross=["x"], rounds=20)
    model.save(str(tmp_path / "meta"))
    got = ensemble.Expert.load(str(tmp_path / "meta"), "p_meta")(df).where("side <> 0 AND x IS NOT NULL").toPandas()
    assert list(got.columns) == ["x", "side", "y", "p_meta"] and ((got.p_meta > 0.5) == (got.y == 1)).mean() > 0.97
    assert model(df).count() == 500


def test_consensus_of_frames(spark):
    """A longer bar counts from its end on; before that there is no agreement."""
    ts = "timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, 0, m) AS ts"
    short = spark.createDataFrame([("A", 30 * k, 1 if k < 5 else -1) for k in range(8)], "asset STRING, m INT, side INT").selectExpr("asset", ts, "side")
    long = spark.createDataFrame([("A", 0, 1), ("A", 60, 1), ("A", 120, -1)], "asset STRING, m INT, side INT").selectExpr("asset", ts, "side")
    got = regimes.consensus([(short, "30 minutes"), (long, "1 hour")]).orderBy("ts").toPandas()
    assert got.signal.tolist() == [0, 1, 1, 1, 1, -1, -1, -1] and got.side_0.tolist() == [1] * 5 + [-1] * 3
    d = spark.createDataFrame([("A", s, r) for s, r in ((0, 0.1), (1, -0.2), (2, 0.3), (2, 0.1))], "asset STRING, state INT, log_ret DOUBLE")
    assert {r.state: r.side for r in regimes.sides(d).collect()} == {0: 0, 1: -1, 2: 1}


def plain_hmm(model, x):
    """Posterior weights, log-likelihood and best path of a whole history, row by row."""
    e, n, k = model.emission(x), len(x), len(model.start)
    f, back, log = np.zeros((n, k)), np.ones((n, k)), 0.0
    best, ptr = np.log(model.start) + e[0], np.zeros((n, k), int)
    for t in range(n):
        f[t] = (model.start if t == 0 else f[t - 1] @ model.move) * np.exp(e[t])
        log += np.log(f[t].sum())
        f[t] /= f[t].sum()
        if t:
            to = best[:, None] + np.log(model.move)
            ptr[t], best = to.argmax(axis=0), to.max(axis=0) + e[t]
    for t in range(n - 2, -1, -1):
        back[t] = model.move @ (np.exp(e[t + 1]) * back[t + 1])
        back[t] /= back[t].sum()
    path = [int(best.argmax())]
    for t in range(n - 1, 0, -1):
        path.append(int(ptr[t, path[-1]]))
    g = f * back
    return g / g.sum(axis=1, keepdims=True), log, path[::-1]


@pytest.mark.parametrize("piece", [1, 7, 64, 130, 2048])
def test_hmm_has_no_borders(spark, piece, monkeypatch):
    """Pieces of any length give the path, weights and likelihood of the whole history, for each of two assets."""
    rng = np.random.default_rng(5)
    x = {a: np.cumsum(rng.standard_normal(n) * 0.4)[:, None] for a, n in (("A", 300), ("B", 1))}
    model = regimes.Hmm(np.array([0.5, 0.3, 0.2]), np.array([[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.1, 0.3, 0.6]]), np.array([[-1.0], [0.0], [1.5]]), np.array([[0.5], [0.3], [0.8]]))
    df = spark.createDataFrame([(a, k, float(v)) for a, s in x.items() for k, v in enumerate(s.ravel())], "asset STRING, ts INT, x DOUBLE")
    monkeypatch.setattr(regimes, "PIECE", piece)
    got = regimes.states(df, model, ["x"]).orderBy("asset", "ts").toPandas()

    def work(f, first, enter, leave):
        e = model.expect(f[["x"]].to_numpy(float), first, enter, leave)
        return pd.DataFrame({"asset": [f.asset.iloc[0]], "w": [e["weight"]], "start": [e["start"]], "moves": [e["moves"].ravel()], "log": e["log"]})

    sums = regimes._with_ends(regimes._pieces(df, ["x"], ["asset"], "ts"), model, ["x"], ["asset"], "ts", work, "asset STRING, w ARRAY<DOUBLE>, start ARRAY<DOUBLE>, moves ARRAY<DOUBLE>, log DOUBLE").toPandas()
    for a, s in x.items():
        g, log, path = plain_hmm(model, s)
        own = sums[sums.asset == a]
        assert got[got.asset == a].state.tolist() == path
        assert np.allclose(np.stack(own.w).sum(axis=0), g.sum(axis=0)) and np.allclose(np.stack(own.start).sum(axis=0), g[0])
        assert math.isclose(own.log.sum(), log) and math.isclose(np.stack(own.moves).sum(), len(s) - 1, abs_tol=1e-9)


def test_gate_weights_sum_to_one(spark):
    df = spark.createDataFrame([([0.0, 0.5, 0.5], 0.2, None, 0.8)], "gate ARRAY<DOUBLE>, a DOUBLE, b DOUBLE, c DOUBLE")
    r = ensemble.blend(df.withColumn("gate", ensemble.floor_weights(F.col("gate"))), ["a", "b", "c"]).first()
    assert math.isclose(sum(r.gate), 1) and math.isclose(r.p_blend, 0.8, abs_tol=1e-5)


def test_factory(walk):
    d = factory.signals(walk, windows=(5, 14), stats=(20,), lag=(1, 2))
    assert 0 < d.count() <= 600 and {"rsi_14", "rsi_14_lag_2", "macd_hist", "fdi_100"} <= set(d.columns)
    assert d.select([F.sum(F.col(c).isNull().cast("int")).alias(c) for c in d.columns]).first()[5] == 0


def test_files(spark, walk, tmp_path):
    for form in ("parquet", "csv", "json"):
        B.write(walk, f"file://{tmp_path}/{form}", form)
    read = B.read_parquet(spark, f"file://{tmp_path}/parquet"), B.read_csv(spark, f"file://{tmp_path}/csv"), B.read_json(spark, f"file://{tmp_path}/json", B.SCHEMA)
    want = walk.agg(F.count("ts"), F.round(F.sum("close"), 6)).first()
    assert all(d.agg(F.count("ts"), F.round(F.sum("close"), 6)).first() == want for d in read)
    k = spark.createDataFrame([("A", "1704067200000", "1.5", "2", "x", "1", "3", "9")], "asset STRING, timestamp STRING, open STRING, high STRING, low STRING, close STRING, volume STRING, turnover STRING")
    r = B.from_klines(k).first()
    assert str(r.ts) == "2024-01-01 00:00:00" and r.low is None and r.open == 1.5


def test_reports(walk):
    twice = walk.unionByName(walk.where("asset = 'A1'").limit(5))
    got = {r.asset: r for r in quality.time_report(twice).collect()}
    assert got["A1"].repeated_ts == 5 and got["A0"].repeated_ts == 0
    assert all(r.grade == "good" for r in quality.interval_report(walk, 3600).collect())
    assert all(r.bad_high_low == 0 for r in quality.ohlc_report(walk).collect())


def test_filters_reach_the_scan(spark):
    plan = B.between(spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts"), "2024-01-02", "2024-01-03")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "value" not in plan.split("ReadSchema")[1]


def test_equity_is_the_product(spark):
    t = spark.createDataFrame([("A", k, 1, 100.0, 100.0 + k) for k in range(5)], "asset STRING, entry_ts INT, side INT, entry_price DOUBLE, exit_price DOUBLE")
    d = trading.trade_returns(t).orderBy("entry_ts").toPandas()
    assert np.allclose(d.equity, 10_000 * np.cumprod(1 + 0.1 * d.net))


def fetch_page(asset, start, end, limit):
    """A page of hourly candles, one of them beyond its end and one twice."""
    rows = [(t, 1.0, 2.0, 0.5, 1.5, 10) for t in range(start, end + 1, 3_600_000)]
    return [rows[0], *rows]


def test_kline_source(spark):
    from barloom.sources import klines

    klines.register(spark)
    spark.sparkContext.addPyFile(__file__)
    day = 24 * 3_600_000
    raw = spark.read.format("klines").options(assets="A, B", start=0, end=10 * day, step=3_600_000, limit=100, fetch="test_operators:fetch_page").load()
    got = B.from_klines(raw)
    assert raw.rdd.getNumPartitions() == 6 and got.count() == 480 and got.select("asset", "ts").distinct().count() == 480


def test_range_expert_is_exact(spark):
    """The 15 nearest training rows on standardised features, with one wide feature, by brute force; blocks and ties."""
    import numpy as np
    from pyspark.sql import functions as F

    from barloom.operators import ensemble

    rng = np.random.default_rng(4)
    x = rng.normal(size=(260, 3)) * [40, 1, 0.01]
    x[200:210] = x[190:200]
    y = (rng.random(260) < 0.4).astype(float)
    d = ensemble.assemble(spark.createDataFrame([(k, float(y[k]), *map(float, x[k])) for k in range(260)], "id LONG, y DOUBLE, a DOUBLE, b DOUBLE, c DOUBLE"), ["a", "b", "c"])
    got = {r.id: r.p_range for r in ensemble.range_expert(d.where("id < 200"), d.where("id >= 200")).collect()}
    z = (x - x[:200].mean(axis=0)) / x[:200].std(axis=0, ddof=1)
    assert len(got) == 60
    for k in got:
        e = np.sqrt(((z[:200] - z[k]) ** 2).sum(axis=1))
        best = np.argsort(e)[:15]
        w = 1 / (e[best] + 1e-9)
        assert abs(got[k] - (w * y[best]).sum() / w.sum()) < 1e-5
    v = spark.createDataFrame([(k, [float(k % 7), float(k % 3)]) for k in range(90)], "id LONG, vector ARRAY<DOUBLE>")
    near = {(r.id, r["rank"]): r.neighbour for r in neighbours.nearest(v.where(F.col("id") < 20), v, 5, block=16).collect()}
    want = {(i, n + 1): j for i in range(20) for n, (_, j) in enumerate(sorted((math.hypot(i % 7 - j % 7, i % 3 - j % 3), j) for j in range(90) if j != i)[:5])}
    assert near == want


def test_ema_counts_values_only(spark):
    """A span of 1, leading and inner nulls, NaN, a column without values; against the recurrence."""
    rows = [("a", k, v, None) for k, v in enumerate([None, None, 10.0, 11.0, None, float("nan"), 13.0, *[float(k % 7) for k in range(300)]])] + [("b", k, 5.0, None) for k in range(3)]
    df = spark.createDataFrame(rows, "asset STRING, ts INT, x DOUBLE, none DOUBLE")
    spans = {"one": ("x", 1), "three": ("x", 3), "fifty": ("x", 50), "never": ("none", 9), "never_1": ("none", 1)}
    for chunk in (100_000, 50):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(windows, "CHUNK_ROWS", chunk)
            got = {(r.asset, r.ts): r for r in windows.ema(df, spans).collect()}
        assert len(got) == len(rows) and got["a", 0].one is None and got["a", 1].three is None
        for name, n in (("one", 1), ("three", 3), ("fifty", 50)):
            at = {}
            for a, k, v, _ in rows:
                if v is not None and v == v:
                    at[a] = v if a not in at else at[a] + 2 / (n + 1) * (v - at[a])
                assert (got[a, k][name] is None) == (a not in at) and (a not in at or math.isclose(got[a, k][name], at[a], rel_tol=1e-9))
        assert all(r.never is None and r.never_1 is None for r in got.values())


def test_correlation_stability_of_constant_columns(spark):
    df = spark.range(600).select(F.lit(3.0).alias("same"), (F.col("id") % 13).cast("double").alias("x"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).cast("double").alias("gaps"), (F.col("id") % 13 % 2).alias("y"), F.floor(F.col("id") / 100).cast("int").alias("fold"))
    got = {r.feature: r.stability for r in selection.correlation_stability(df, ["same", "x", "gaps"], "y").collect()}
    rows = df.toPandas()
    want = {}
    for c in ("x", "gaps"):
        r = np.array([rows[rows.fold < k][[c, "y"]].corr().iloc[0, 1] for k in range(1, 6)])
        want[c] = 1 / (1 + r.std() / (abs(r.mean()) + 1e-6))
    assert got["same"] == 0 and math.isclose(got["x"], want["x"], rel_tol=1e-6) and math.isclose(got["gaps"], want["gaps"], rel_tol=1e-6)


def test_ruined_accounts_stay_ruined(spark):
    """A loss of the whole account, trades after it, a gain of many times, an entry at a price of 0."""
    rows = [("a", 0, 1, 100.0, 110.0), ("a", 1, 1, 10.0, 90.0), ("a", 2, -1, 10.0, 200.0), ("a", 3, 1, 10.0, 20.0), ("b", 0, 1, 0.0, 5.0), ("b", 1, 1, 10.0, 11.0)]
    df = spark.createDataFrame(rows, "asset STRING, entry_ts INT, side INT, entry_price DOUBLE, exit_price DOUBLE")
    got = {(r.asset, r.entry_ts): r for r in trading.trade_returns(df, fee=0.0, slippage=0.0).collect()}
    assert [round(got["a", k].equity, 6) for k in range(4)] == [10_100.0, 18_180.0, 0.0, 0.0] and [got["a", k].ruined for k in range(4)] == [False, False, True, True]
    assert got["a", 3].drawdown == -1 and got["b", 0].net is None and got["b", 0].equity == 10_000 and math.isclose(got["b", 1].equity, 10_100)
    stats = {r.asset: r for r in trading.trade_statistics(trading.trade_returns(df, fee=0.0, slippage=0.0)).collect()}
    assert stats["a"].total_return == -1 and stats["a"].n == 4


@pytest.mark.parametrize(("every", "start"), [("30 days", 10_000.0), ("1 hours", 1_500.0), ("20 hours", 1_100.0), ("7 hours", 300.0), ("50 hours", 2_000.0)])
def test_guarded_accounts(spark, every, start):
    """Against an account row by row: sizes of 0 and null, gaps in x, prices of 0, ties of cash and cost, chunks of all sizes."""
    rng = np.random.default_rng(len(every) + int(start))
    rows = []
    for a in ("a", "b", None):
        x = np.clip(50 + np.cumsum(rng.normal(0, 9, 300)) % 60 - 30, 0, 100)
        for k in range(300):
            rows.append((a, k, None if k < 14 or rng.random() < 0.02 else float(x[k]), 0.0 if rng.random() < 0.01 else float(rng.choice([5.0, 8.0, 10.0, 12.0])), None if rng.random() < 0.05 else float(rng.choice([0.0, 0.5, 1.0, 1.5])), "own"))
    df = spark.createDataFrame(rows, "asset STRING, k INT, rsi_14 DOUBLE, close DOUBLE, size DOUBLE, cash STRING").withColumn("ts", F.expr("timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, k)")).repartition(3)
    got = {(r.asset, r.k): r for r in accounts.guarded(df, stake=1_000.0, start=start, size="size", every=every).collect()}
    assert len(got) == len(rows)
    states = {a: [start, 0.0, 0, 0, 0] for a in ("a", "b", None)}
    for a, k, x, close, size, _ in rows:
        s, pay = states[a], 1_000.0 * (size or 0.0)
        if x is not None and x < 30 and not s[1]:
            if pay <= 0:
                s[3] += 1
            elif s[0] < pay or close <= 0:
                s[4] += 1
            else:
                s[0], s[1], s[2] = s[0] - pay, pay / close, s[2] + 1
        elif x is not None and x > 50 and s[1]:
            s[0], s[1] = s[0] + s[1] * close, 0.0
        r = got[a, k]
        assert (r.position, r.n_trades, r.skipped, r.refused) == (int(s[1] != 0), *s[2:]) and math.isclose(r.cash, s[0], abs_tol=1e-6) and math.isclose(r.equity, s[0] + s[1] * close, abs_tol=1e-6)


@pytest.mark.parametrize(("dims", "k", "block"), [(1, 3, 7), (3, 5, 16), (3, 15, 4096), (8, 1, 20)])
def test_pruned_neighbours_are_exact(spark, dims, k, block):
    """Clusters, hundreds of equal rows, ties, queries that aren't rows; few rows are compared where they lie in clusters."""
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(c, 0.3, (60, dims)) for c in (0, 10, 20, 30, 40)] + [np.full((300, dims), 5.0), rng.integers(0, 3, (40, dims)).astype(float)])
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in enumerate(x)], "id LONG, vector ARRAY<DOUBLE>").repartition(4)
    more = spark.createDataFrame([(10_000, [5.0] * dims), (10_001, [1e6] * dims)], df.schema)
    q = df.where("id % 7 = 0").unionByName(more)
    got = {(r.id, r["rank"]): (r.neighbour, r.distance) for r in neighbours.nearest(q, df, k, block).collect()}
    vs = {r.id: np.array(r.vector) for r in q.collect()}
    for i, v in vs.items():
        d = np.zeros(len(x))
        for j in range(dims):
            d += (v[j] - x[:, j]) ** 2
        d = np.sqrt(d)
        best = sorted((d[n], n) for n in range(len(x)) if n != i)[:k]
        assert [got[i, r + 1] for r in range(k)] == [(n, e) for e, n in best]
    assert len(got) == k * len(vs)
    if block < 4096 and dims > 1:
        near = df.where("id < 300 AND id % 7 = 0")
        assert neighbours.compared(near, df, k, block).agg(F.sum("compared")).first()[0] < 0.5 * near.count() * len(x)
    assert neighbours.nearest(q, df.where("false"), k, block).count() == 0 and neighbours.nearest(q.where("false"), df, k, block).count() == 0


@pytest.mark.parametrize("sharp", [10_000, 20])
def test_quantiles_of_any_size(spark, sharp, monkeypatch):
    """Against sorting: single values, ties, NaN, nulls, keys without values, 5,000 values against brackets of a twentieth."""
    monkeypatch.setattr(quantiles, "SHARP", sharp)
    rng = np.random.default_rng(3)
    own = {"a": rng.normal(size=5000), "b": np.array([3.0]), "c": rng.integers(0, 4, 999).astype(float), None: np.array([1.0, 2.0]), "d": np.arange(7.0)}
    rows = [(k, float(v), None) for k, vs in own.items() for v in vs] + [("a", float("nan"), None), ("a", None, None), ("e", None, 1.0)]
    df = spark.createDataFrame(rows, "asset STRING, x DOUBLE, y DOUBLE").repartition(5)
    shares = [0.0, 0.01, 0.25, 0.5, 0.501, 0.75, 1.0]
    got = {(r.asset, r.metric): r for r in quantiles.exact(df, ["x", "y"], shares).collect()}
    assert len(got) == 12 and got["e", "x"].n == 0 and got["e", "x"]["values"] == [None] * 7 and got["e", "y"]["values"] == [1.0] * 7
    for k, vs in own.items():
        assert got[k, "x"].n == len(vs) and np.allclose(got[k, "x"]["values"], np.quantile(vs, shares), rtol=1e-12)


def test_profile_metrics_are_the_single_operators(spark, walk):
    """One pass in chunks gives what the operators give one by one; verdicts cover every metric."""
    m = profiler.metrics(walk, hurst=30, theta=40, entropy=25, fracdiff=20, vol=8, d=0.4).orderBy("asset", "ts").toPandas()
    d = rolling.returns(walk)
    one = rolling.hurst(d, 30, name="hurst").orderBy("asset", "ts").toPandas()
    two = rolling.stability(d, window=40, span=40, current=False).orderBy("asset", "ts").toPandas()
    three = rolling.entropy(d, 25, "pct_ret").orderBy("asset", "ts").toPandas()
    four = rolling.vol_of_vol(d, "pct_ret", 8).orderBy("asset", "ts").toPandas()
    five = physics.frac_diff(walk, 0.4, cut=1e-3, name="fd").orderBy("asset", "ts").toPandas()
    tie = pd.concat([g.close.rolling(20).corr(g.fd) for _, g in five.groupby("asset")])
    for got, want in ((m.hurst, one.hurst), (m.theta, two.theta), (m.entropy, three.entropy_25), (m.vol_of_vol, four.vol_of_vol), (m.fracdiff_corr, tie)):
        np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), rtol=1e-6, atol=1e-9)
    said = profiler.diagnose(profiler.summary(spark.createDataFrame(m))).collect()
    assert len(said) == 15 and all(r.verdict for r in said)


def test_gates_and_regimes_are_saved(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.standard_normal(300)
    df = spark.createDataFrame(pd.DataFrame({"k": range(300), "vol": x, "range": rng.standard_normal(300), "oracle": (x > 0).astype(float)}))
    gate = ensemble.gate(df, ["vol", "range"], 2)
    gate.save(str(tmp_path / "gate"))
    a, b = (g(df).orderBy("k").collect() for g in (gate, ensemble.Gate.load(str(tmp_path / "gate"))))
    assert a == b and all(math.isclose(sum(r.gate), 1) for r in a) and np.mean([(r.gate[1] > 0.5) == (r.oracle == 1) for r in a]) > 0.95
    model = regimes.Hmm(np.array([0.4, 0.6]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[0.1], [-0.1]]), np.array([[1.0], [2.0]]))
    model.save(spark, str(tmp_path / "hmm"))
    again = regimes.Hmm.load(spark, str(tmp_path / "hmm"))
    assert all(np.array_equal(getattr(model, f), getattr(again, f)) for f in ("start", "move", "mean", "var"))

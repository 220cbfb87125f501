"""Moments and gradients as sums over tasks: against refits, finite differences and plain shuffles."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import sums
from barloom.operators import batches, ensemble, graph, selection, temporal


@pytest.fixture(scope="module")
def table(spark):
    """x0 and x1 carry y, x2 repeats x0, x3 is noise, x4 has nulls, x5 never changes."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((800, 4))
    x[:, 2] = x[:, 0] + 0.1 * x[:, 2]
    y = (x[:, 0] + 0.8 * x[:, 1] + 0.7 * rng.standard_normal(800) > 0).astype(float)
    f = pd.DataFrame({f"x{k}": x[:, k] for k in range(4)} | {"x4": [None if k % 9 == 0 else v for k, v in enumerate(rng.standard_normal(800) + y)], "x5": 1.0, "y": y, "id": range(800)})
    return spark.createDataFrame(f).withColumn("x4", F.when(~F.isnan("x4"), F.col("x4"))).repartition(7)


def newton(x, y, ridge=1e-6):
    x = np.column_stack([x, np.ones(len(y))])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
    z = x @ b
    return (y * z - np.logaddexp(0, z)).sum()


def test_sums_of_tasks(spark, table, monkeypatch):
    monkeypatch.setattr(sums, "PIECE", 3)
    got = sums.summed(table, ["x0", "y"], lambda b: np.outer(b["x0"], np.arange(5)) .sum(axis=0), 5)
    want = table.agg(F.sum("x0")).first()[0]
    assert np.allclose(got, want * np.arange(5)) and not sums.summed(table.where("false"), ["x0"], lambda b: b["x0"], 4).any()


def test_moments(table):
    c = ["x0", "x1", "x4", "x5"]
    gram, f = selection.Gram.of(table, c, "y"), table.toPandas()[[*c, "y"]].dropna().astype(float)
    assert gram.n == len(f) and np.allclose(gram.mean, f.mean()) and np.allclose(gram.cov, f.cov(), atol=1e-12)


def test_many_columns(spark):
    """The moments of 400 columns are one plan of a few expressions."""
    wide = spark.range(300).select(*(F.pmod(F.col("id") * (2 * k + 1), F.lit(17)).cast("double").alias(f"c{k}") for k in range(400)), (F.col("id") % 2).cast("double").alias("y"))
    gram = selection.Gram.of(wide, [f"c{k}" for k in range(400)], "y")
    assert np.allclose(gram.cov, wide.toPandas().cov(), atol=1e-9)


def test_clusters_that_talk(spark, table):
    """Correlation between clusters falls; moments and residuals are those of regressions one after another, also when saved."""
    c = ["x0", "x1", "x2", "x3"]
    gram = selection.Gram.of(table, c, "y")
    own = {"x0": 0, "x1": 1, "x2": 2, "x3": 1}
    talk, after = selection.tensor_talk(gram, own)
    f = talk.transform(table).toPandas()
    residuals = f[[f"tt_{x}" for x in c] + ["y"]]
    assert np.allclose(after.cov, residuals.cov(), atol=1e-10)
    assert abs(residuals.corr().iloc[0, 2]) < 0.1 < 0.9 < abs(f[c].corr().iloc[0, 2]) and any(s[:2] in ([0, 2], [2, 0]) for s in talk.steps)
    fixed, _ = selection.tensor_talk(gram, own, fixed=[(1, 0, 0.5), (0, 2, 1.0)])
    g, x = fixed.transform(table).toPandas(), f[c].to_numpy() - f[c].to_numpy().mean(axis=0)
    x0 = x[:, 0] - 0.5 * x[:, [1, 3]] @ np.linalg.lstsq(x[:, [1, 3]], x[:, 0], rcond=None)[0]
    x2 = x[:, 2] - x0 * (x0 @ x[:, 2]) / (x0 @ x0)
    order = g.set_index("id").loc[f["id"]]
    assert np.allclose(order.tt_x0 - f.x0.mean(), x0) and np.allclose(order.tt_x2 - f.x2.mean(), x2) and np.allclose(order.tt_x1, f.x1)


def test_talking_latents_are_saved(spark, table, tmp_path):
    own = {"x0": 0, "x1": 1, "x2": 2, "x3": 1}
    talk, after = selection.tensor_talk(selection.Gram.of(table, [*own], "y"), own)
    model = selection.latents(after, own, talk=talk)
    model.save(spark, str(tmp_path / "m"))
    a, b = (m.transform(table).orderBy("id").toPandas() for m in (model, selection.Latents.load(spark, str(tmp_path / "m"))))
    names = [c for c in a.columns if c.startswith("tf_")]
    assert len(names) >= 3 and np.allclose(a[names], b[names]) and np.allclose(a[names].mean(), 0, atol=1e-9)
    assert np.abs(np.corrcoef(a.tf_cluster0_pc0, a.tf_cluster2_pc0)[0, 1]) < 0.1


def test_score_tests_and_gains_are_refits(table):
    f = table.toPandas()
    y = f.y.to_numpy()
    base = selection.logit(table, ["x0"], "y")
    assert math.isclose(base.log, newton(f[["x0"]], y), rel_tol=1e-8)
    tests = selection.score_tests(table, base, ["x1", "x2", "x3", "x5"], "y")
    for c in ("x1", "x2", "x3"):
        gain = 2 * (newton(f[["x0", c]], y) - base.log)
        assert abs(tests[c] - gain) < 0.35 * gain + 0.5
    assert tests["x5"] == 0 and max(tests, key=tests.get) == "x1"
    taken = selection.greedy_classifier(table, ["x3", "x5", "x2", "x1", "x0"], "y")
    assert {c for c, _ in taken[:2]} in ({"x0", "x1"}, {"x2", "x1"}) and not {"x3", "x5"} & {c for c, _ in taken}
    for k, (_, gain) in enumerate(taken):
        with_, without = ([c for c, _ in taken[:n]] for n in (k + 1, k))
        assert math.isclose(gain, 2 * (newton(f[with_], y) - newton(f[without], y)), rel_tol=1e-5, abs_tol=1e-5)
    assert [c for c, _ in selection.greedy_classifier(table, ["x4", "x3"], "y", least=1)] == ["x4"]


def test_shuffled_batches(spark):
    df = spark.range(1000).select("id", F.lit("own").alias("batch")).repartition(6)
    got = {r.id: (r.batch, r.place) for r in batches.shuffled_batches(df, ["id"], 64).collect()}
    order = sorted(range(1000), key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())
    assert got == {i: (k // 64, k % 64) for k, i in enumerate(order) if k < 960}
    again = {r.id: (r.batch, r.place) for r in batches.shuffled_batches(df.repartition(3), ["id"], 64, whole=False).collect()}
    assert len(again) == 1000 and {i: again[i] for i in got} == got and len({*again.values()}) == 1000
    assert batches.shuffled_batches(df, ["id"], 64, seed=8).where("id < 5").collect() != [(i, *got[i]) for i in range(5) if i in got]
    assert batches.shuffled_batches(df.where("false"), ["id"], 64).count() == 0


def test_windows_of_common_times(spark):
    rows = [(a, k) for a, n in (("a", 1), ("b", 2), ("c", 5)) for k in range(0, 90) if k % n == 0 and (a, k) != ("b", 40)]
    df = spark.createDataFrame(rows, "asset STRING, k INT").withColumn("ts", F.expr("timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, k)"))
    common = [k for k in range(0, 90, 10) if k != 40]
    got = sorted((r.sequence[-1][0], [s[0] for s in r.sequence]) for r in batches.intersection_windows(df, "k", ["a", "b", "c"], 3, every="48 hours").collect())
    assert got == [(common[i], common[i - 2 : i + 1]) for i in range(2, len(common))]


def test_gradients_are_finite_differences():
    shape = temporal.Shape(channels=3, width=4, dilations=(1, 2, 5))
    rng = np.random.default_rng(0)
    theta, x, y = shape.begin(1) + 0.1 * rng.standard_normal(shape.size), rng.standard_normal((6, 9, 3)), rng.integers(0, 2, 6).astype(float)
    _, g = temporal.gradient(shape, theta, x, y)
    for k in range(shape.size):
        e = np.zeros(shape.size)
        e[k] = 1e-6
        assert abs((temporal.gradient(shape, theta + e, x, y)[0] - temporal.gradient(shape, theta - e, x, y)[0]) / 2e-6 - g[k]) < 1e-5
    # Filters look back only: a change at a step leaves what comes before it.
    late = x.copy()
    late[:, 6:] += 1
    assert np.allclose(temporal._forward(shape, theta, x)[1][-1][:, :6], temporal._forward(shape, theta, late)[1][-1][:, :6])


def test_a_network_learns_an_order(spark, tmp_path):
    """y is 1 where the rise came before the fall: means of the steps say nothing."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(0, 0.3, (900, 12, 2)), rng.integers(0, 2, 900)
    for i in range(900):
        up, down = sorted(rng.choice(12, 2, replace=False))[:: 1 if y[i] else -1]
        x[i, up, 0] += 2
        x[i, down, 1] += 2
    df = spark.createDataFrame([(i, x[i].tolist() if i % 50 else None, float(y[i])) for i in range(900)], "id INT, sequence ARRAY<ARRAY<DOUBLE>>, y DOUBLE").repartition(4)
    model = temporal.fit(df.where("id < 700"), ["id"], rounds=70, size=256, rate=0.03)
    model.save(spark, str(tmp_path / "m"))
    f = temporal.Temporal.load(spark, str(tmp_path / "m"))(df).where("id >= 700").toPandas()
    assert f[f.sequence.isna()].p_temporal.isna().all()
    f = f.dropna()
    ranks = f.p_temporal.rank()
    ones = f.y == 1
    auc = (ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    assert auc > 0.85, auc


def test_windows_feed_the_network(spark):
    df = spark.range(50).select(F.lit("a").alias("asset"), F.expr("timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, id)").alias("ts"), (F.col("id") % 5).cast("double").alias("v"), (F.col("id") % 2).cast("double").alias("y"))
    model = temporal.fit(ensemble.windows_of(df, ["v", "y"], 4), ["ts"], rounds=2)
    assert model(ensemble.windows_of(df, ["v", "y"], 4)).where("p_temporal IS NULL").count() == 3


def test_gradients_of_the_graph_are_finite_differences():
    """With assets that aren't there, labels that aren't known, and a time without any."""
    layers, rng = graph.Layers(3, 4, 3), np.random.default_rng(0)
    theta, x, y = layers.begin(1) + 0.1 * rng.standard_normal(layers.size), rng.standard_normal((5, 4, 3)), rng.integers(0, 2, (5, 4)).astype(float)
    x[0, 1], x[1, 2, 0], y[2, 3], x[4] = np.nan, np.nan, np.nan, np.nan
    _, g = graph.gradient(layers, theta, x, y)
    for k in range(layers.size):
        e = np.zeros(layers.size)
        e[k] = 1e-6
        assert abs((graph.gradient(layers, theta + e, x, y)[0] - graph.gradient(layers, theta - e, x, y)[0]) / 2e-6 - g[k]) < 1e-5


def test_assets_learn_from_each_other(spark):
    """y of every asset is the sign of the feature of the one that trades most: an asset's own features say little."""
    rng = np.random.default_rng(4)
    names, rows = ["a", "b", "c", "d"], []
    for t in range(700):
        v, m = rng.standard_normal(4), rng.permutation(4)
        for i in range(4):
            if t % 40 or i:
                rows.append((names[i], t, float(v[i]), float(m[i] == 3) * 2, float(v[np.argmax(m)] > 0)))
    df = spark.createDataFrame(rows, "asset STRING, ts INT, ret DOUBLE, active DOUBLE, y DOUBLE").repartition(5)
    model = graph.fit(df.where("ts < 500"), names, ["ret", "active"], rounds=110, size=250, rate=0.06)
    f = model(df).join(df, ["asset", "ts"]).toPandas()
    assert len(f) == len(rows) and np.allclose([sum(w) for w in f.weights], 1) and all(w[0] == 0 for w in f[f.ts % 40 == 0].weights)
    f = f[f.ts >= 500]
    ranks, ones = f.p_graph.rank(), f.y == 1
    auc = (ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    assert auc > 0.8, auc

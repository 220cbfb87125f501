"""Experts on MLlib, their gating and blend, oracle targets, meta labels, and when to train again."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import Roll, bounded, clip, ratio
from barloom.operators.neighbours import nearest


def assemble(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(df)


def balanced(df: DataFrame, y: str = "y", name: str = "weight") -> DataFrame:
    """name: the inverse share of the row's class, 1 on average."""
    s = df.groupBy(y).agg(F.count(F.lit(1)).alias("_n"))
    t = s.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    return df.join(F.broadcast(s.join(F.broadcast(t)).select(y, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias(name))), y)  # a row per class


@dataclass
class Expert:
    """A fitted pipeline whose probability of class 1 becomes the column `name`: called on rows, saved and loaded."""

    model: PipelineModel
    name: str

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df).select(*df.columns, vector_to_array("probability")[1].alias(self.name))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @staticmethod
    def load(path: str, name: str) -> "Expert":
        return Expert(PipelineModel.load(path), name)


def _boosted(features: str, y: str, rounds: int, depth: int, seed: int) -> GBTClassifier:
    """Boosting that ends when a round gains less than a thousandth on the rows marked _stop."""
    return GBTClassifier(labelCol=y, featuresCol=features, maxIter=rounds, maxDepth=depth, seed=seed, validationIndicatorCol="_stop", validationTol=0.001)


def _tenth(*columns) -> Column:
    """Marks a tenth of the rows, by a hash of their values."""
    return F.pmod(F.xxhash64(*columns), F.lit(10)) == 0


def trend_expert(train: DataFrame, y: str = "y", asset: str | None = None, rounds: int = 500, depth: int = 4, seed: int = 42) -> Expert:
    """Boosted trees, p_trend; the asset enters as an index fitted on the training rows."""
    index = [StringIndexer(inputCol=asset, outputCol="_asset", handleInvalid="keep")] if asset else []
    wide = VectorAssembler(inputCols=["features", *["_asset"] * len(index)], outputCol="_fa")
    marked = train.withColumn("_stop", _tenth(vector_to_array("features")))
    return Expert(Pipeline(stages=[*index, wide, _boosted("_fa", y, rounds, depth, seed)]).fit(marked), "p_trend")


def stress_expert(train: DataFrame, y: str = "y", c: float = 0.1) -> Expert:
    n = max(1, train.count())
    return Expert(Pipeline(stages=[LogisticRegression(labelCol=y, weightCol="_w", regParam=1 / (c * n), maxIter=50)]).fit(balanced(train, y, "_w")), "p_stress")


def forest(train: DataFrame, y: str = "y", trees: int = 20, depth: int = 6, seed: int = 42) -> Expert:
    return Expert(Pipeline(stages=[RandomForestClassifier(labelCol=y, numTrees=trees, maxDepth=depth, seed=seed)]).fit(train), "p_forest")


def range_expert(train: DataFrame, rows: DataFrame, y: str = "y", key: str = "id", k: int = 15) -> DataFrame:
    """rows with p_range: distance-weighted share of y = 1 among the k nearest training rows, on features standardised over train.

    Exact (neighbours.nearest). train and rows: key, features; a row is no neighbour of itself.
    """
    scale = StandardScaler(inputCol="features", outputCol="_s", withMean=True, withStd=True).fit(train)
    scaled = lambda d: scale.transform(d.select(F.col(key).alias("id"), "features")).select("id", vector_to_array("_s").alias("vector"))
    near = nearest(scaled(rows), scaled(train), k).select(F.col("id").alias(key), F.col("neighbour").alias("_t"), F.col("distance").alias("_d"))
    near = near.join(train.select(F.col(key).alias("_t"), F.col(y).alias("_y")), "_t")
    w = 1 / (F.col("_d") + 1e-9)
    p = near.groupBy(key).agg((F.sum(w * F.col("_y")) / F.sum(w)).alias("p_range"))
    return rows.join(p, key, "left")


def ou_expert(df: DataFrame, z: str, vol: str, alpha: float = 1.0, damp: float = 1.0) -> DataFrame:
    """p_ou: 1 / (1 + e^(alpha z)), drawn towards 1/2 by volatility, within 0.01..0.99."""
    raw = 1 / (1 + F.exp(F.lit(alpha) * clip(z, -50, 50)))
    return df.withColumn("p_ou", clip(0.5 + (raw - 0.5) / (1 + damp * F.col(vol)), 0.01, 0.99))


def cross_entropy(p: Column, y: Column, eps: float = 1e-7) -> Column:
    q = clip(p, eps, 1 - eps)
    return -F.when(y == 1, F.ln(q)).otherwise(F.ln(1 - q))


def oracle_target(df: DataFrame, experts: Sequence[str], y: str = "y", limit: float = 0.8, fallback: int | None = None) -> DataFrame:
    """oracle: place of the expert of least loss (the first of equals); the fallback (the last) if even that is above the limit."""
    losses = F.array(*(cross_entropy(F.col(e), F.col(y)) for e in experts))
    d = df.withColumn("_l", losses).withColumn("oracle_loss", F.array_min("_l"))
    best = (F.array_position("_l", F.col("oracle_loss")) - 1).cast("int")
    return d.withColumn("oracle", F.when(F.col("oracle_loss") > limit, len(experts) - 1 if fallback is None else fallback).otherwise(best)).drop("_l")


@dataclass
class Gate:
    """A fitted network from physics columns to a weight per expert: rows -> rows with gate (an array of them); saved and loaded."""

    model: PipelineModel

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df).withColumn("gate", floor_weights(vector_to_array("_gp"))).drop("_g", "_gp", "_gr", "_gx")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @staticmethod
    def load(path: str) -> "Gate":
        return Gate(PipelineModel.load(path))


def gate(train: DataFrame, columns: Sequence[str], k: int, target: str = "oracle", seed: int = 42) -> Gate:
    """A small network from physics columns to a weight per expert."""
    a = VectorAssembler(inputCols=list(columns), outputCol="_g", handleInvalid="keep")
    net = MultilayerPerceptronClassifier(labelCol=target, featuresCol="_g", layers=[len(columns), 8, k], maxIter=40, seed=seed, probabilityCol="_gp", rawPredictionCol="_gr", predictionCol="_gx")
    return Gate(Pipeline(stages=[a, net]).fit(train.dropna(subset=list(columns))))


def floor_weights(w: Column, least: float = 1e-6) -> Column:
    """Weights of at least `least`, summing to one."""
    up = F.transform(w, lambda x: F.greatest(x, F.lit(least)))
    return F.transform(up, lambda x: x / F.aggregate(up, F.lit(0.0), lambda s, v: s + v))


def blend(df: DataFrame, experts: Sequence[str], gate: str = "gate", name: str = "p_blend") -> DataFrame:
    """Weighted mean of the experts; an expert that is null leaves its weight to the others."""
    ps = F.array(*experts)
    part = lambda use: F.aggregate(F.zip_with(F.col(gate), ps, use), F.lit(0.0), lambda s, v: s + v)
    top, weight = part(lambda w, p: w * F.coalesce(p, F.lit(0.0))), part(lambda w, p: F.when(p.isNotNull(), w).otherwise(0.0))
    return df.withColumn(name, ratio(top, weight))


def telemetry(df: DataFrame, experts: Sequence[str], gate: str = "gate", by: Sequence[str] = ("asset",)) -> DataFrame:
    return df.groupBy(*by).agg(*(F.avg(F.col(gate)[i]).alias(f"weight_{e}") for i, e in enumerate(experts)), *(F.avg(e).alias(f"mean_{e}") for e in experts))


def meta_model(train: DataFrame, columns: Sequence[str], y: str = "y", side: str = "side", cross: Sequence[str] = (), rounds: int = 400, depth: int = 5, seed: int = 42) -> Expert:
    """The second model, p_meta: the chance that a trade of the first one wins, by boosted trees on the rows with a side.

    Features are the columns (null is 0), the side and its products with the columns in `cross`. A null y is no win.
    """
    plain = [f"nanvl(coalesce(double(`{c}`), 0D), 0D) AS `_m_{c}`" for c in columns]
    own = [f"double(coalesce(`{side}`, 0)) AS _m_side", *(f"nanvl(coalesce(double(`{c}`) * `{side}`, 0D), 0D) AS `_x_{c}`" for c in cross)]
    add = SQLTransformer(statement=f"SELECT *, {', '.join([*plain, *own])} FROM __THIS__")
    wide = VectorAssembler(inputCols=[*(f"_m_{c}" for c in columns), "_m_side", *(f"_x_{c}" for c in cross)], outputCol="_mf")
    trades = train.where(F.col(side) != 0).withColumns({"_win": F.coalesce((F.col(y) == 1).cast("double"), F.lit(0.0)), "_stop": _tenth(*columns)})
    return Expert(Pipeline(stages=[add, wide, _boosted("_mf", "_win", rounds, depth, seed)]).fit(trades), "p_meta")


def meta_filter(df: DataFrame, p: str = "p", side: str = "side", limit: float = 0.55) -> DataFrame:
    """meta_side: the side where it is not 0 and the second model's probability is above the limit, else 0."""
    return df.withColumn("meta_side", F.when((F.col(side) != 0) & (F.col(p) > limit), F.col(side)).otherwise(0))


def training_plan(df: DataFrame, entropy: str, vol: str, perf: str, shallow: int = 3, deep: int = 8) -> DataFrame:
    """depth grows with entropy and falls with volatility; retrain if the performance fell by a fifth or more."""
    depth = F.round(shallow + (deep - shallow) * clip(F.col(entropy) / 4, 0.0, 1.0) * (1 - clip(vol, 0.0, 1.0) / 2)).cast("int")
    return df.withColumns({"depth": depth, "retrain": F.coalesce(F.col(perf) <= -0.2, F.lit(False))})


def random_search(train: DataFrame, val: DataFrame, y: str = "y", trials: int = 10, seed: int = 42) -> list[dict]:
    """Trials of random depth and most rounds of boosted trees, best first by validation AUC, then by the gap to training."""
    import random

    from barloom.operators.metrics import roc_auc

    grid, out = [(d, r) for d in range(2, 6) for r in (20, 50, 100)], []
    for depth, rounds in random.Random(seed).sample(grid, min(trials, len(grid))):
        model = trend_expert(train, y, rounds=rounds, depth=depth, seed=seed)
        auc = [roc_auc(model(d), "p_trend", y).first()["auc"] or 0.5 for d in (val, train)]
        out.append({"depth": depth, "rounds": rounds, "auc": float(auc[0]), "gap": float(abs(auc[1] - auc[0]))})
    return sorted(out, key=lambda r: (-r["auc"], r["gap"], r["depth"], r["rounds"]))


@bounded(lambda a: a["n"])
def windows_of(df: DataFrame, columns: Sequence[str], n: int, by: Sequence[str] = ("asset",)) -> DataFrame:
    """sequence: for each row an array of the last n rows' columns (null until there are n), for sequence models."""
    seq = F.collect_list(F.array(*columns)).over(Roll(by).frame(n))
    return df.withColumn("sequence", F.when(F.size(seq) == n, seq))

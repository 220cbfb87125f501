"""A temporal convolutional network over sequences: gradients of a mini-batch are sums over tasks, weights stay small.

Causal filters with growing dilation, each added to what it filters; the mean and the last step of what comes out are
weighed by a logistic unit. A round is a job over one batch that returns as many numbers as there are weights.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from barloom.operators.batches import descend
from barloom.shipping import ship


@dataclass
class Shape:
    """channels of the input, width of the hidden layers, dilations of the filters, taps of each."""

    channels: int
    width: int = 8
    dilations: tuple[int, ...] = (1, 2, 4)
    taps: int = 3

    def split(self, theta: np.ndarray) -> list[np.ndarray]:
        """The weights as arrays: into the first layer, each filter's and its offset, out of the last layer."""
        w, out, at = self.width, [], 0
        for shape in [(self.channels, w), (w,), *(s for _ in self.dilations for s in ((self.taps, w, w), (w,))), (2 * w,), (1,)]:
            n = int(np.prod(shape))
            out.append(theta[at : at + n].reshape(shape))
            at += n
        return out

    @property
    def size(self) -> int:
        w = self.width
        return self.channels * w + w + len(self.dilations) * (self.taps * w * w + w) + 2 * w + 1

    def begin(self, seed: int) -> np.ndarray:
        rng, parts = np.random.default_rng(seed), []
        for p in self.split(np.zeros(self.size)):
            parts.append(np.zeros(p.size) if p.ndim == 1 else rng.normal(0, 1 / np.sqrt(np.prod(p.shape[:-1])), p.shape).ravel())
        return np.concatenate(parts)


def _late(h: np.ndarray, steps: int) -> np.ndarray:
    """Each sequence so many steps later, zeros before it."""
    out = np.zeros_like(h)
    if steps < h.shape[1]:
        out[:, steps:] = h[:, : h.shape[1] - steps]
    return out


def _early(g: np.ndarray, steps: int) -> np.ndarray:
    out = np.zeros_like(g)
    if steps < g.shape[1]:
        out[:, : g.shape[1] - steps] = g[:, steps:]
    return out


def _forward(shape: Shape, theta: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Logits, and the activations on the way."""
    first, offset, *blocks, head, bias = shape.split(theta)
    h = np.tanh(x @ first + offset)
    kept = [h]
    for (w, b), d in zip(zip(blocks[::2], blocks[1::2]), shape.dilations, strict=True):
        a = np.tanh(sum(_late(h, k * d) @ w[k] for k in range(shape.taps)) + b)
        h = h + a
        kept += [a, h]
    return np.concatenate([h.mean(axis=1), h[:, -1]], axis=1) @ head + bias[0], kept


def predicted(shape: Shape, theta: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-_forward(shape, theta, x)[0]))


def gradient(shape: Shape, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """The summed cross-entropy of sequences x (rows, steps, channels) and its gradient."""
    first, offset, *blocks, head, bias = shape.split(theta)
    z, kept = _forward(shape, theta, x)
    last = kept[-1]
    up = 1 / (1 + np.exp(-z)) - y
    pooled = np.concatenate([last.mean(axis=1), last[:, -1]], axis=1)
    grads = [pooled.T @ up, np.array([up.sum()])]
    w = shape.width
    g = np.repeat((up[:, None] * head[:w] / last.shape[1])[:, None], last.shape[1], axis=1)
    g[:, -1] += up[:, None] * head[w:]
    for i in range(len(shape.dilations) - 1, -1, -1):
        weights, a, h, d = blocks[2 * i], kept[2 * i + 1], kept[2 * i], shape.dilations[i]
        ga = g * (1 - a * a)
        grads = [np.stack([np.einsum("nti,ntj->ij", _late(h, k * d), ga) for k in range(shape.taps)]), ga.sum(axis=(0, 1)), *grads]
        g = g + sum(_early(ga, k * d) @ weights[k].T for k in range(shape.taps))
    g0 = g * (1 - kept[0] ** 2)
    grads = [np.einsum("nti,ntj->ij", x, g0), g0.sum(axis=(0, 1)), *grads]
    return float((np.logaddexp(0, z) - y * z).sum()), np.concatenate([p.ravel() for p in grads])


@dataclass
class Temporal:
    """A trained network: its shape, weights and the scale of its inputs."""

    shape: Shape
    theta: list[float]
    mean: list[float]
    scale: list[float]

    def __call__(self, df: DataFrame, sequence: str = "sequence", name: str = "p_temporal") -> DataFrame:
        """df with the probability of 1; null where the sequence is."""
        ship(df.sparkSession)
        shape, theta, mean, scale = self.shape, np.array(self.theta), np.array(self.mean), np.array(self.scale)

        @pandas_udf("double")
        def p(s: pd.Series) -> pd.Series:
            out, there = np.full(len(s), np.nan), s.notna().to_numpy()
            if there.any():
                x = np.stack([np.stack(v) for v in s[there]]).astype(float)
                out[there] = predicted(shape, theta, (x - mean) / scale)
            return pd.Series(out).replace({np.nan: None}).astype("float64")

        return df.withColumn(name, p(sequence))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model STRING").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Temporal:
        held = json.loads(spark.read.parquet(path).first()[0])
        shape = held.pop("shape")
        return Temporal(Shape(**{**shape, "dilations": tuple(shape["dilations"])}), **held)


def fit(df: DataFrame, key: list[str], y: str = "y", sequence: str = "sequence", width: int = 8, dilations: tuple[int, ...] = (1, 2, 4), rounds: int = 40, size: int = 4096, rate: float = 0.02, seed: int = 7) -> Temporal:
    """Trained by Adam on shuffled mini-batches, one after another and again from the first.

    df: rows told apart by key, with sequences of one length (an array of steps, each an array of numbers) and y of 0 or 1;
    rows with nulls in either are left out. size: rows of a batch at most.
    """
    rows = df.where(F.col(sequence).isNotNull() & F.col(y).isNotNull()).select(*key, F.col(sequence).alias("_x"), F.col(y).cast("double").alias("_y"))
    mean, scale = scales(rows.select(F.explode("_x").alias("s")))
    shape = Shape(len(mean), width, tuple(dilations))
    step = lambda theta, b: gradient(shape, theta, (b["_x"] - mean) / scale, b["_y"])[1]
    theta = descend(rows, key, step, shape.begin(seed), rounds, size, rate)
    return Temporal(shape, theta.tolist(), mean.tolist(), scale.tolist())


def scales(steps: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation (1 for none) of each place of the arrays s."""
    first = steps.first()
    if first is None:
        raise ValueError("no rows to train on")
    found = steps.agg(*(f(F.col("s")[k]) for k in range(len(first[0])) for f in (F.avg, F.stddev_pop))).first()
    return np.array([x or 0.0 for x in found[::2]]), np.array([x if x and x > 1e-12 else 1.0 for x in found[1::2]])

"""A network over the assets of one time: each looks at the others, those of more energy more, before it is judged.

Energy is a small network of an asset's features. What an asset gives to another is a softmax over all assets of that time
of how its key fits the other's query, plus what it has more in energy (bounded). Times are rows, so they are dealt over
tasks; gradients of a mini-batch are sums over them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.batches import descend
from barloom.operators.temporal import scales
from barloom.shipping import ship

#: How much energy counts beside the fit of key and query, at most.
PULL = 2.0


@dataclass
class Layers:
    """channels: features of an asset; width of keys, queries and the hidden layer; hidden: of the energy network."""

    channels: int
    width: int = 6
    hidden: int = 4

    def shapes(self) -> list[tuple[int, ...]]:
        c, w, h = self.channels, self.width, self.hidden
        return [(c, h), (h,), (h,), (1,), (c, w), (c, w), (c, w), (c, w), (w,), (w,), (1,)]

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes())

    def split(self, theta: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes()])
        return [theta[e - int(np.prod(s)) : e].reshape(s) for e, s in zip(ends, self.shapes(), strict=True)]

    def begin(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([(rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or s[0] > 1 else np.zeros(s)).ravel() for s in self.shapes()])


def _forward(layers: Layers, theta: np.ndarray, x: np.ndarray, there: np.ndarray) -> dict[str, np.ndarray]:
    """x: times, assets, features (zeros where an asset isn't there)."""
    w1, b1, w2, b2, wq, wk, wv, ws, bs, u, c = layers.split(theta)
    inner = np.tanh(x @ w1 + b1)
    energy = 1 / (1 + np.exp(-(inner @ w2 + b2[0])))
    more = np.tanh(energy[:, None, :] - energy[:, :, None])
    q, k, v = x @ wq, x @ wk, x @ wv
    s = q @ k.transpose(0, 2, 1) / np.sqrt(layers.width) + PULL * more
    s = np.where(there[:, None, :], s, -np.inf)
    top = s.max(axis=2, keepdims=True)
    a = np.exp(s - np.where(np.isfinite(top), top, 0.0))
    a = a / np.maximum(a.sum(axis=2, keepdims=True), 1e-300)
    h = np.tanh(a @ v + x @ ws + bs)
    return {"inner": inner, "energy": energy, "more": more, "q": q, "k": k, "v": v, "a": a, "h": h, "z": h @ u + c[0]}


def gradient(layers: Layers, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """The summed cross-entropy and its gradient. x: NaN where an asset isn't there; y: NaN where it isn't known."""
    there = ~np.isnan(x).any(axis=2)
    known = there & ~np.isnan(y)
    x, y = np.where(there[:, :, None], x, 0.0), np.where(known, y, 0.0)
    w1, b1, w2, b2, wq, wk, wv, ws, bs, u, c = layers.split(theta)
    f = _forward(layers, theta, x, there)
    z, a, root = f["z"], f["a"], np.sqrt(layers.width)
    loss = float(((np.logaddexp(0, z) - y * z) * known).sum())
    up = (1 / (1 + np.exp(-z)) - y) * known
    gz = up[:, :, None] * u * (1 - f["h"] ** 2)
    ga = gz @ f["v"].transpose(0, 2, 1)
    gs = a * (ga - (a * ga).sum(axis=2, keepdims=True))
    gd = PULL * (1 - f["more"] ** 2) * gs
    ge = (gd.sum(axis=1) - gd.sum(axis=2)) * f["energy"] * (1 - f["energy"])
    g1 = ge[:, :, None] * w2 * (1 - f["inner"] ** 2)
    by = lambda g: np.einsum("tac,taw->cw", x, g)
    parts = [
        by(g1), g1.sum(axis=(0, 1)), (ge[:, :, None] * f["inner"]).sum(axis=(0, 1)), np.array([ge.sum()]), by(gs @ f["k"] / root), by(gs.transpose(0, 2, 1) @ f["q"] / root),
        by(a.transpose(0, 2, 1) @ gz), by(gz), gz.sum(axis=(0, 1)), (up[:, :, None] * f["h"]).sum(axis=(0, 1)), np.array([up.sum()]),
    ]
    return loss, np.concatenate([p.ravel() for p in parts])


def panel(df: DataFrame, assets: Sequence[str], features: Sequence[str], y: str | None = None, ts: str = "ts") -> DataFrame:
    """ts, x (a row of features for each of the assets, in that order) and y; nulls where an asset isn't there. One row of an asset and time."""
    held = df.where(F.col("asset").isin(*assets)).groupBy(ts).agg(F.map_from_entries(F.collect_list(F.struct("asset", F.struct(F.array(*(F.col(c).cast("double") for c in features)).alias("x"), (F.col(y).cast("double") if y else F.lit(None).cast("double")).alias("y"))))).alias("m"))
    nothing = F.array(*[F.lit(None).cast("double")] * len(features))
    row = lambda a: F.try_element_at("m", F.lit(a))
    return held.select(ts, F.array(*(F.coalesce(row(a)["x"], nothing) for a in assets)).alias("x"), F.array(*(row(a)["y"] for a in assets)).alias("y"))


@dataclass
class Graph:
    """A trained network of some assets and features."""

    assets: list[str]
    features: list[str]
    layers: Layers
    theta: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def __call__(self, df: DataFrame, ts: str = "ts") -> DataFrame:
        """asset, ts, p_graph, energy, weights (of each asset, in order; they add up to 1) for each row whose features are known."""
        ship(df.sparkSession)
        rows = panel(df, self.assets, self.features, ts=ts).select(ts, "x")
        layers, theta, mean, scale, assets = self.layers, self.theta, self.mean, self.scale, self.assets
        kind = rows.schema[ts].dataType.simpleString()

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if not len(f):
                    continue
                x = np.stack([np.stack([np.asarray(v, float) for v in r]) for r in f.x])
                there = ~np.isnan(x).any(axis=2)
                out = _forward(layers, theta, np.where(there[:, :, None], (x - mean) / scale, 0.0), there)
                t, a = np.nonzero(there)
                yield pd.DataFrame({"asset": np.array(assets, object)[a], ts: f[ts].to_numpy()[t], "p_graph": (1 / (1 + np.exp(-out["z"])))[t, a], "energy": out["energy"][t, a], "weights": [*out["a"][t, a]]})

        return rows.mapInPandas(work, f"asset STRING, {ts} {kind}, p_graph DOUBLE, energy DOUBLE, weights ARRAY<DOUBLE>")


def fit(df: DataFrame, assets: Sequence[str], features: Sequence[str], y: str = "y", ts: str = "ts", width: int = 6, hidden: int = 4, rounds: int = 40, size: int = 2048, rate: float = 0.02, seed: int = 7) -> Graph:
    """Trained by Adam on shuffled mini-batches of times. df: asset, ts, features, y (0 or 1; null where unknown)."""
    rows = panel(df, assets, features, y, ts)
    mean, scale = scales(df.where(F.col("asset").isin(*assets)).select(F.array(*(F.col(c).cast("double") for c in features)).alias("s")))
    layers = Layers(len(features), width, hidden)
    step = lambda theta, b: gradient(layers, theta, (b["x"] - mean) / scale, b["y"])[1]
    theta = descend(rows, [ts], step, layers.begin(seed), rounds, size, rate)
    return Graph([*assets], [*features], layers, theta, mean, scale)

"""Hidden-state regimes: a Gaussian HMM fitted by EM over pieces of the histories, states by Viterbi, and their names."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.windows import ratio, running_sum
from barloom.shipping import ship

#: Rows of a history in one piece, and rows in one of the blocks of a piece that are worked on side by side.
PIECE, BLOCK = 2048, 64
MODEL = "start ARRAY<DOUBLE>, move ARRAY<ARRAY<DOUBLE>>, mean ARRAY<ARRAY<DOUBLE>>, var ARRAY<ARRAY<DOUBLE>>"


def _blocks(steps: np.ndarray, nothing: np.ndarray) -> np.ndarray:
    """A matrix per row -> blocks x BLOCK x states x states, filled up with matrices that change nothing."""
    fill = np.broadcast_to(nothing, (-len(steps) % BLOCK, *nothing.shape))
    return np.concatenate([steps, fill]).reshape(-1, BLOCK, *nothing.shape)


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p = a @ b
    return p / np.maximum(p.max(axis=(-2, -1), keepdims=True), 1e-300)


def _maxima(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)


def _fold(blocks: np.ndarray, times) -> np.ndarray:
    """The product of each block's matrices."""
    p = blocks[:, 0]
    for s in range(1, blocks.shape[1]):
        p = times(p, blocks[:, s])
    return p


def _ends(m: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of a row of matrices the distribution before it and the backward weights after it."""
    into, out = np.empty(m.shape[:2]), np.empty(m.shape[:2])
    for i in range(len(m)):
        into[i] = enter
        enter = enter @ m[i]
        enter = enter / max(enter.sum(), 1e-300)
    for i in range(len(m) - 1, -1, -1):
        out[i] = leave
        leave = m[i] @ leave
        leave = leave / max(leave.sum(), 1e-300)
    return into, out


def _best_ends(m: np.ndarray, enter: np.ndarray, leave: int | None = None) -> np.ndarray:
    """For each of a row of matrices of best scores the state in which the best path leaves it (the last one's may be given)."""
    before = np.empty(m.shape[:2])
    for i in range(len(m)):
        before[i] = enter
        enter = (enter[:, None] + m[i]).max(axis=0)
    out = np.empty(len(m), int)
    out[-1] = enter.argmax() if leave is None else leave
    for i in range(len(m) - 1, 0, -1):
        out[i - 1] = (before[i] + m[i][:, out[i]]).argmax()
    return out


@dataclass
class Hmm:
    """A row is a matrix: from the state before it to its own. A piece is the product of its rows' matrices, so what comes
    before and after it enters as one vector each, and pieces of a history give what the whole history would."""

    start: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    def save(self, spark: SparkSession, path: str) -> None:
        """One row of four arrays."""
        spark.createDataFrame([(self.start.tolist(), self.move.tolist(), self.mean.tolist(), self.var.tolist())], MODEL).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Hmm":
        return Hmm(*map(np.array, spark.read.schema(MODEL).parquet(path).first()))

    def emission(self, x: np.ndarray) -> np.ndarray:
        """log density of each row in each state."""
        d = x[:, None, :] - self.mean[None]
        return -0.5 * (np.log(2 * np.pi * self.var)[None] + d * d / self.var[None]).sum(axis=2)

    def _steps(self, e: np.ndarray, first: bool) -> np.ndarray:
        a = self.move[None] * np.exp(e)[:, None, :]
        if first:
            a[0] = self.start * np.exp(e[0])
        return a

    def _scores(self, x: np.ndarray, first: bool) -> np.ndarray:
        e = self.emission(x)
        a = np.log(self.move + 1e-300)[None] + e[:, None, :]
        if first:
            a[0] = np.log(self.start + 1e-300) + e[0]
        return a

    def _stay(self) -> np.ndarray:
        return np.where(np.eye(len(self.start)) > 0, 0.0, -np.inf)

    def whole(self, x: np.ndarray, first: bool) -> np.ndarray:
        """The product of a piece's matrices, up to a factor."""
        e = self.emission(x)
        m = _fold(_blocks(self._steps(e - e.max(axis=1, keepdims=True), first), np.eye(len(self.start))), _sums)
        return _fold(m[None], _sums)[0]

    def best_whole(self, x: np.ndarray, first: bool) -> np.ndarray:
        """The best score of a piece from each state before it to each state at its end."""
        return _fold(_fold(_blocks(self._scores(x, first), self._stay()), _maxima)[None], _maxima)[0]

    def expect(self, x: np.ndarray, first: bool, enter: np.ndarray, leave: np.ndarray) -> dict[str, np.ndarray]:
        """Sums that a round of EM needs of one piece, the move into its first row included."""
        e = self.emission(x)
        top, n, k = e.max(axis=1, keepdims=True), len(x), len(self.start)
        a = self._steps(e - top, first)
        b = _blocks(a, np.eye(k))
        v, w = _ends(_fold(b, _sums), enter, leave)
        f, back, scale = np.empty(b.shape[:3]), np.empty(b.shape[:3]), np.empty(b.shape[:2])
        for s in range(BLOCK):
            v = np.einsum("bi,bij->bj", v, b[:, s])
            scale[:, s] = np.maximum(v.sum(axis=1), 1e-300)
            f[:, s] = v = v / scale[:, s, None]
        for s in range(BLOCK - 1, -1, -1):
            back[:, s] = w
            w = np.einsum("bij,bj->bi", b[:, s], w)
            w = w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300)
        f, back = f.reshape(-1, k)[:n], back.reshape(-1, k)[:n]
        g = f * back
        g /= g.sum(axis=1, keepdims=True)
        pairs = np.concatenate([enter[None], f[:-1]])[:, :, None] * a * back[:, None, :]
        pairs /= np.maximum(pairs.sum(axis=(1, 2), keepdims=True), 1e-300)
        start = g[0] if first else np.zeros(k)
        return {"start": start, "moves": pairs[int(first) :].sum(axis=0), "weight": g.sum(axis=0), "x": g.T @ x, "xx": g.T @ (x * x), "log": np.array([np.log(scale).sum() + top.sum()])}

    def path(self, x: np.ndarray, first: bool = True, enter: int = 0, leave: int | None = None) -> np.ndarray:
        """States of the best path through a piece, from a state before it to one at its end."""
        b, k = _blocks(self._scores(x, first), self._stay()), len(self.start)
        ends = _best_ends(_fold(b, _maxima), np.where(np.arange(k) == enter, 0.0, -np.inf), leave)
        at, begin = np.arange(len(b)), np.concatenate([[enter], ends[:-1]])
        best, back, out = b[at, 0, begin], np.zeros(b.shape[:3], int), np.empty(b.shape[:2], int)
        for s in range(1, BLOCK):
            to = best[:, :, None] + b[:, s]
            back[:, s], best = to.argmax(axis=1), to.max(axis=1)
        out[:, -1] = ends
        for s in range(BLOCK - 1, 0, -1):
            out[:, s - 1] = back[at, s, out[:, s]]
        return out.ravel()[: len(x)]


def _pieces(df: DataFrame, columns: Sequence[str], by: Sequence[str], ts: str) -> DataFrame:
    ship(df.sparkSession)
    held = running_sum(df.dropna(subset=list(columns)).select(*by, ts, *columns), F.lit(1), "_n", by, ts)
    return held.withColumn("_piece", F.floor((F.col("_n") - 1) / PIECE)).repartition(*by, "_piece")


def _with_ends(pieces: DataFrame, model: Hmm, columns: Sequence[str], by: Sequence[str], ts: str, work, schema: str, best: bool = False) -> DataFrame:
    """work(piece in order, first, enter, leave) of each piece. Of a whole history one task sees a small matrix per piece."""
    kinds = ", ".join(f"{x} {pieces.schema[x].dataType.simpleString()}" for x in (*by, "_piece"))
    c, keys, k = list(columns), [*by, "_piece"], len(model.start)

    def matrix(f: pd.DataFrame) -> pd.DataFrame:
        x, first = f.sort_values(ts)[c].to_numpy(float), f["_piece"].iloc[0] == 0
        return f[keys].head(1).assign(m=[(model.best_whole if best else model.whole)(x, first).ravel()])

    def ends(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("_piece")
        m = np.stack(f.m).reshape(-1, k, k)
        if best:
            out = _best_ends(m, np.where(np.arange(k) == 0, 0.0, -np.inf))[:, None].astype(float)
            return f[keys].assign(enter=[*np.concatenate([[[0.0]], out[:-1]])], leave=[*out])
        into, out = _ends(m, np.full(k, 1 / k), np.full(k, 1 / k))
        return f[keys].assign(enter=[*into], leave=[*out])

    def each(f: pd.DataFrame, end: pd.DataFrame) -> pd.DataFrame:
        return work(f.sort_values(ts), f["_piece"].iloc[0] == 0, np.asarray(end.enter.iloc[0], float), np.asarray(end.leave.iloc[0], float))

    m = pieces.groupBy(*keys).applyInPandas(matrix, f"{kinds}, m ARRAY<DOUBLE>")
    found = m.groupBy(*by).applyInPandas(ends, f"{kinds}, enter ARRAY<DOUBLE>, leave ARRAY<DOUBLE>")
    return pieces.groupBy(*keys).cogroup(found.groupBy(*keys)).applyInPandas(each, schema)


def fit(df: DataFrame, columns: Sequence[str], states: int = 3, rounds: int = 100, by: Sequence[str] = ("asset",), ts: str = "ts", tol: float = 1e-5) -> Hmm:
    """One model of all keys. Each round is a job over pieces of histories that returns a few sums per piece, added up in Spark.

    Begins with states at quantiles of the first column; ends when the likelihood's logarithm gains less than tol of
    itself, after `rounds` at the latest.
    """
    pieces = _pieces(df, columns, by, ts).cache()
    share = [(i + 0.5) / states for i in range(states)]
    c = list(columns)
    stats = pieces.agg(*(F.percentile_approx(c[0], F.lit(p)).alias(f"q{i}") for i, p in enumerate(share)), *(F.avg(x).alias(f"m_{x}") for x in c), *(F.var_samp(x).alias(f"v_{x}") for x in c)).first()
    if stats["q0"] is None:
        raise ValueError("no rows without nulls to fit on")
    mean = np.array([[stats[f"q{i}"], *(stats[f"m_{x}"] for x in c[1:])] for i in range(states)])
    var = np.array([[max(stats[f"v_{x}"] or 0.0, 1e-8) for x in c]] * states)
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9)
    model, before = Hmm(np.full(states, 1 / states), move, mean, var), -np.inf
    names = ("start", "moves", "weight", "x", "xx", "log")

    def step(model: Hmm):
        def work(f: pd.DataFrame, first: bool, enter: np.ndarray, leave: np.ndarray) -> pd.DataFrame:
            e = model.expect(f[c].to_numpy(float), first, enter, leave)
            return pd.DataFrame({"name": [n for n in names for _ in e[n].ravel()], "i": [i for n in names for i in range(e[n].size)], "v": np.concatenate([e[n].ravel() for n in names])})

        return work

    for _ in range(rounds):
        rows = _with_ends(pieces, model, c, by, ts, step(model), "name STRING, i INT, v DOUBLE").groupBy("name", "i").agg(F.sum("v").alias("v")).toPandas()
        s = {n: rows[rows.name == n].sort_values("i").v.to_numpy() for n in names}
        w = np.maximum(s["weight"], 1e-9)[:, None]
        mean = s["x"].reshape(states, -1) / w
        moves = s["moves"].reshape(states, states) + 1e-6
        model = Hmm(s["start"] / s["start"].sum(), moves / moves.sum(axis=1, keepdims=True), mean, np.maximum(s["xx"].reshape(states, -1) / w - mean**2, 1e-8))
        log = float(s["log"][0])
        if log - before < tol * abs(log):
            break
        before = log
    pieces.unpersist()
    return model


def states(df: DataFrame, model: Hmm, columns: Sequence[str], by: Sequence[str] = ("asset",), ts: str = "ts") -> DataFrame:
    """by, ts, columns, state of each row without nulls in the columns: the Viterbi path of its whole history."""
    pieces = _pieces(df, columns, by, ts)
    schema = ", ".join(f"{x} {pieces.schema[x].dataType.simpleString()}" for x in (*by, ts, *columns)) + ", state INT"

    def work(f: pd.DataFrame, first: bool, enter: np.ndarray, leave: np.ndarray) -> pd.DataFrame:
        path = model.path(f[list(columns)].to_numpy(float), first, int(enter[0]), int(leave[0]))
        return f[[*by, ts, *columns]].assign(state=path.astype(np.int32))

    return _with_ends(pieces, model, columns, by, ts, work, schema, best=True)


def name_states(df: DataFrame, ret: str = "log_ret", vol: str = "vol", by: Sequence[str] = ("asset",)) -> DataFrame:
    """regime: Stress is the state of most volatility, Trend that of the largest mean return of the others, else Range."""
    g = df.groupBy(*by, "state").agg(F.avg(vol).alias("_v"), F.abs(F.avg(ret)).alias("_r"))
    w = W.partitionBy(*by)
    g = g.withColumn("_top", F.row_number().over(w.orderBy(F.col("_v").desc(), "state")))
    g = g.withColumn("_second", F.row_number().over(w.orderBy((F.col("_top") == 1), F.col("_r").desc(), "state")))
    g = g.select(*by, "state", F.when(F.col("_top") == 1, "Stress").when(F.col("_second") == 1, "Trend").otherwise("Range").alias("regime"))
    return df.join(F.broadcast(g), [*by, "state"])  # a row per key and state


def sides(df: DataFrame, ret: str = "log_ret", by: Sequence[str] = ("asset",)) -> DataFrame:
    """side: 1 in the state of the largest mean return, -1 in that of the smallest, else 0 (one state alone is 1)."""
    g = df.groupBy(*by, "state").agg(F.avg(ret).alias("_r"))
    w = W.partitionBy(*by)
    g = g.withColumns({"_up": F.row_number().over(w.orderBy(F.col("_r").desc(), "state")), "_down": F.row_number().over(w.orderBy("_r", F.col("state").desc()))})
    return df.join(F.broadcast(g.select(*by, "state", F.when(F.col("_up") == 1, 1).when(F.col("_down") == 1, -1).otherwise(0).alias("side"))), [*by, "state"])  # a row per key and state


def consensus(frames: Sequence[tuple[DataFrame, str]], by: Sequence[str] = ("asset",)) -> DataFrame:
    """Rows of the first frame (the shortest bars) with the sides of all as side_0, side_1, ..., and signal: the side where all agree, else 0.

    frames: (by, ts, side) and the length of a bar. A longer bar is known at its end, a row of the first frame at its own.
    """
    from barloom.operators.joins import asof

    step = F.expr(f"INTERVAL {frames[0][1]}")
    out = frames[0][0].select(*by, (F.col("ts") + step).alias("ts"), F.col("side").alias("side_0"))
    for k, (d, length) in enumerate(frames[1:], 1):
        out = asof(out, d.select(*by, "ts", F.col("side").alias(f"side_{k}")), [f"side_{k}"], by=by, available=length)
    same = F.array_distinct(F.array(*(f"side_{k}" for k in range(len(frames)))))
    return out.select(*by, (F.col("ts") - step).alias("ts"), *(f"side_{k}" for k in range(len(frames))), F.coalesce(F.when(F.size(same) == 1, F.col("side_0")), F.lit(0)).alias("signal"))


def typing(df: DataFrame, ret: str = "log_ret", vol: str = "vol", by: Sequence[str] = ("asset",)) -> DataFrame:
    """Per state: rows, mean return, volatility and a type by the sign of the one and the other against the median of states."""
    g = df.groupBy(*by, "state").agg(F.count(F.lit(1)).alias("n"), F.avg(ret).alias("mean_ret"), F.avg(vol).alias("mean_vol"))
    mid = g.groupBy(*by).agg(F.percentile("mean_vol", F.lit(0.5)).alias("_m"))
    up, wild = F.col("mean_ret") > 0, F.col("mean_vol") > F.col("_m")
    kind = F.when(up & wild, "volatile up").when(up, "calm up").when(wild, "volatile down").otherwise("calm down")
    return g.join(mid, list(by)).withColumn("type", kind).drop("_m")


def separation(df: DataFrame, x: str = "log_ret", by: Sequence[str] = ("asset",)) -> DataFrame:
    """Per pair of states: shares of rows and the Bhattacharyya distance of their normal fits."""
    g = df.groupBy(*by, "state").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v"))
    total = F.sum("n").over(W.partitionBy(*by))
    g = g.withColumn("share", F.col("n") / total)
    a, b = (g.select(*by, *(F.col(c).alias(f"{c}_{s}") for c in ("state", "share", "m", "v"))) for s in "ab")
    d = a.join(b, list(by)).where("state_a < state_b")
    dm = F.col("m_a") - F.col("m_b")
    v = F.col("v_a") + F.col("v_b")
    dist = ratio(dm * dm, 4 * v) + 0.5 * F.ln(ratio(v, 2 * F.sqrt(F.col("v_a") * F.col("v_b"))))
    return d.select(*by, "state_a", "state_b", "share_a", "share_b", dist.alias("distance"))


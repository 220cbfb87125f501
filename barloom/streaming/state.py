"""Operators on streams that carry state from row to row of a key: indicators, and regimes of several frames.

Rows of a key wait in list state until the watermark has passed them and are then taken in order of time, so files may
bring them in any order; a timer wakes a key that gets no more rows. What a key has come to is value (or map) state, so a
query goes on from its checkpoint where it stopped. State of a key is a few numbers, and rows of the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.operators.regimes import Hmm
from barloom.shipping import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a bar takes along while it waits: its moment (microseconds), its frame, its prices and volume.
BAR = "at BIGINT, frame INT, ts BIGINT, close DOUBLE, volume DOUBLE"


def keyed_state(spark: SparkSession) -> None:
    """Keep state in RocksDB, as state of this kind needs, unless the session has a store of its own."""
    ship(spark)
    if spark.conf.get(PROVIDER).endswith("HDFSBackedStateStoreProvider"):  # its default
        spark.conf.set(PROVIDER, ROCKS)


class InOrder(StatefulProcessor):
    """Takes each key's bars in order of (at, -frame) once the watermark is at `at` or later."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", BAR)
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def take(self, key: tuple, bars: list[tuple]) -> Iterator[pd.DataFrame]:
        """Results of bars (at, frame, ts, close, volume) that come next."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for f in rows for r in f[["at", "frame", "ts", "close", "volume"]].itertuples(index=False, name=None)]
        return self._go(key, new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._go(key, [], timerValues)

    def _go(self, key, new: list[tuple], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [*self.waiting.get(), *new] if self.waiting.exists() else new
        ready = sorted((r for r in held if r[0] // 1000 <= now), key=lambda r: (r[0], -r[1]))
        left = [r for r in held if r[0] // 1000 > now]
        if left:
            self.waiting.put([(int(a), int(f), int(t), float(c), float(v)) for a, f, t, c, v in left])
            self.handle.registerTimer(int(min(r[0] for r in left) // 1000))
        else:
            self.waiting.clear()
        if ready:
            yield from self.take(key, ready)


class Indicators(InOrder):
    """Exponential averages of closes, OBV, RSI and the position of an RSI hysteresis, as the batch operators have them."""

    def __init__(self, spans: dict[str, int], length: int = 14, buy: float = 30, sell: float = 50):
        self.spans, self.length, self.buy, self.sell = spans, length, buy, sell

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "averages ARRAY<DOUBLE>, obv DOUBLE, close DOUBLE, position INT, gains ARRAY<DOUBLE>, losses ARRAY<DOUBLE>")

    def take(self, key, bars) -> Iterator[pd.DataFrame]:
        averages, obv, last, position, gains, losses = self.now.get() if self.now.exists() else ([], 0.0, None, 0, [], [])
        averages, gains, losses, out = [*averages], [*gains], [*losses], []
        for _, _, ts, close, volume in bars:
            change = 0.0 if last is None else close - last
            averages = [a + 2 / (n + 1) * (close - a) for a, n in zip(averages, self.spans.values(), strict=True)] if averages else [close] * len(self.spans)
            obv += float(np.sign(change)) * volume
            gains, losses = [*gains, max(change, 0.0)][-self.length :], [*losses, max(-change, 0.0)][-self.length :]
            rsi = None
            if len(gains) == self.length:
                rsi = 100 - 100 / (1 + sum(gains) / self.length / (sum(losses) / self.length + 1e-10))
                position = 1 if rsi < self.buy else 0 if rsi > self.sell else position
            last = close
            out.append((*key, ts, close, volume, *averages, obv, rsi, position))
        self.now.update((averages, obv, last, position, gains, losses))
        yield pd.DataFrame(out, columns=["asset", "ts", "close", "volume", *self.spans, "obv", f"rsi_{self.length}", "position"])


class Filter(InOrder):
    """Probabilities of each frame's hidden states given its returns so far, and the side on which all frames agree."""

    def __init__(self, models: Sequence[Hmm]):
        self.models = [*models]

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.frames = handle.getMapState("frames", "frame INT", "close DOUBLE, p ARRAY<DOUBLE>")

    def take(self, key, bars) -> Iterator[pd.DataFrame]:
        held = {f: self.frames.getValue((f,)) if self.frames.containsKey((f,)) else (None, None) for f in range(len(self.models))}
        out = []
        for _, frame, ts, close, _ in bars:
            last, p = held[frame]
            if last is not None and last > 0 and close > 0:
                p = forward(self.models[frame], p, np.log(close / last))
            held[frame] = (close, p)
            if frame == 0:
                sides = [None if q is None else side(m, q) for m, (_, q) in zip(self.models, held.values(), strict=True)]
                out.append((*key, ts, close, [None if q is None else [float(v) for v in q] for _, q in held.values()], sides, sides[0] if sides[0] is not None and len({*sides}) == 1 else 0))
        for f, (close, p) in held.items():
            if close is not None:
                self.frames.updateValue((f,), (float(close), None if p is None else [float(v) for v in p]))
        if out:
            yield pd.DataFrame(out, columns=["asset", "ts", "close", "probabilities", "sides", "signal"])


def forward(model: Hmm, p: Sequence[float] | None, ret: float) -> np.ndarray:
    """State probabilities after one more return; p: those before it (None for the first)."""
    e = model.emission(np.array([[ret]]))[0]
    q = (model.start if p is None else np.asarray(p) @ model.move) * np.exp(e - e.max())
    return q / max(q.sum(), 1e-300)


def side(model: Hmm, p: np.ndarray) -> int:
    """1 if the likeliest state has the largest mean return, -1 if it has the smallest, else 0."""
    state, means = int(np.argmax(p)), model.mean[:, 0]
    return 1 if state == int(np.argmax(means)) else -1 if state == int(np.argmin(means)) else 0


def _waiting(bars: DataFrame, frame: int, length: str) -> DataFrame:
    """Bars with the moment from which they are known."""
    return bars.select("asset", F.unix_micros(F.col("ts") + F.expr(f"INTERVAL {length}")).alias("at"), F.lit(frame).alias("frame"), F.unix_micros("ts").alias("ts"), F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume"))


def indicators(bars: DataFrame, length: str, spans: dict[str, int], rsi: int = 14, buy: float = 30, sell: float = 50) -> DataFrame:
    """asset, ts, close, volume, an average for each of spans, obv, rsi_n, position of a stream of bars (asset, ts, close, volume).

    length: of a bar; bars are taken once the watermark has passed their ends. Late bars are dropped by the watermark.
    """
    keyed_state(bars.sparkSession)
    schema = ", ".join(["asset STRING, ts BIGINT, close DOUBLE, volume DOUBLE", *(f"{n} DOUBLE" for n in spans), f"obv DOUBLE, rsi_{rsi} DOUBLE, position INT"])
    out = _waiting(bars, 0, length).groupBy("asset").transformWithStateInPandas(Indicators(spans, rsi, buy, sell), schema, "append", "eventTime")
    return out.withColumn("ts", F.timestamp_micros("ts"))


def decisions(frames: Sequence[tuple[DataFrame, str, Hmm]]) -> DataFrame:
    """asset, ts, close, probabilities and sides by frame, and signal (the side if all frames agree, else 0) of each bar of the first frame.

    frames: streams of bars, the length of a bar and its model of log returns, the shortest first. A bar counts from its
    end on. The state of all frames of an asset is kept together, so frames meet without a join of streams.
    """
    keyed_state(frames[0][0].sparkSession)
    every = [_waiting(bars, k, length) for k, (bars, length, _) in enumerate(frames)]
    both = every[0]
    for more in every[1:]:
        both = both.unionByName(more)
    schema = "asset STRING, ts BIGINT, close DOUBLE, probabilities ARRAY<ARRAY<DOUBLE>>, sides ARRAY<INT>, signal INT"
    out = both.groupBy("asset").transformWithStateInPandas(Filter([m for _, _, m in frames]), schema, "append", "eventTime")
    return out.withColumn("ts", F.timestamp_micros("ts"))

"""Streams against the batch operators: files in any order, restarts from a checkpoint, candles of a service."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.windows import ema
from barloom.operators import indicators as I
from barloom.operators import regimes, rolling, trading
from barloom.sources import bars as B
from barloom.sources import klines
from barloom.streaming import live, state

SPANS = {"ema_5": 5, "ema_20": 20}


@pytest.fixture(scope="module")
def ticks(spark):
    return spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "event_type", "value", "ts")


@pytest.fixture(scope="module")
def five_files(spark, ticks, tmp_path_factory):
    """The ticks in five files in order of time, each with rows of the next within the watermark's delay."""
    at = tmp_path_factory.mktemp("ticks")
    lo, hi = (r.timestamp() for r in ticks.agg(F.min("ts"), F.max("ts")).first())
    part = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - lo - F.col("event_id") % 300) / ((hi - lo + 1) / 5))
    dealt = ticks.withColumn("part", F.greatest(F.lit(0), F.least(F.lit(4), part.cast("int"))))
    for k in range(5):
        dealt.where(F.col("part") == k).drop("part").coalesce(1).write.parquet(str(at / f"part{k}"))
    return at


def in_files(spark, folder, parts, into):
    """Some of the files as one folder that a stream watches, oldest first."""
    import os
    import shutil
    import time

    for k in parts:
        for f in sorted((folder / f"part{k}").glob("*.parquet")):
            to = shutil.copy(f, into / f"{k}.parquet")
            os.utime(to, (time.time() - 1000 + k, time.time() - 1000 + k))


def test_indicators_of_a_stream_are_the_batch_operators(spark, ticks, five_files, tmp_path):
    """Five files, two of them read before a restart."""
    watched = tmp_path / "watched"
    watched.mkdir()
    sink, checkpoint = str(tmp_path / "sink"), str(tmp_path / "checkpoint")
    for parts in ((0, 1), (2, 3, 4)):
        in_files(spark, five_files, parts, watched)
        bars = live.stream_bars(live.ticks(spark, str(watched), files_per_batch=1), every="15 minutes")
        live.run(state.indicators(bars, "15 minutes", SPANS, buy=40, sell=55), sink, checkpoint).awaitTermination()
    got = {(r.asset, r.ts): r for r in live.plain_time(spark.read.parquet(sink)).collect()}
    assert len(got) == spark.read.parquet(sink).count()
    whole = B.event_bars(spark, "/root/testdata/sf0.001", "15 minutes")
    batch = trading.hysteresis(I.rsi(I.obv(ema(whole, {n: ("close", k) for n, k in SPANS.items()}))), buy=40, sell=55).collect()
    end = ticks.agg(F.max("ts")).first()[0].timestamp() - 600
    want = {(r.asset, r.ts): r for r in batch if r.ts.timestamp() + 900 <= end}
    assert got.keys() == want.keys() and len(got) > 50
    for k, r in want.items():
        assert got[k].position == r.position and got[k].close == r.close
        assert all(math.isclose(got[k][c], r[c], rel_tol=1e-9) for c in (*SPANS, "obv")) and (r.rsi_14 is None) == (got[k].rsi_14 is None)


def test_decisions_are_a_forward_pass(spark, five_files, tmp_path):
    """Probabilities of each frame, over a restart, are those of the whole history; sides meet as the batch consensus has it."""
    watched = tmp_path / "watched"
    watched.mkdir()
    sink, checkpoint = str(tmp_path / "sink"), str(tmp_path / "checkpoint")
    move = np.array([[0.8, 0.1, 0.1], [0.2, 0.6, 0.2], [0.1, 0.1, 0.8]])
    models = [regimes.Hmm(np.full(3, 1 / 3), move, np.array([[m], [0.0], [-m]]), np.full((3, 1), v)) for m, v in ((0.4, 0.5), (0.3, 0.4), (0.2, 0.3))]
    lengths = ("15 minutes", "30 minutes", "1 hour")
    for parts in ((0, 1, 2), (3, 4)):
        in_files(spark, five_files, parts, watched)
        frames = [(live.stream_bars(live.ticks(spark, str(watched), files_per_batch=1), every=n), n, m) for n, m in zip(lengths, models)]
        live.run(state.decisions(frames), sink, checkpoint, score=live.named).awaitTermination()
    got = {(r.asset, r.ts): r for r in live.plain_time(spark.read.parquet(sink)).collect()}
    assert len(got) == spark.read.parquet(sink).count() > 50
    filtered = {}
    for k, (n, m) in enumerate(zip(lengths, models)):
        rows = rolling.returns(B.event_bars(spark, "/root/testdata/sf0.001", n)).orderBy("ts").collect()
        at = {}
        for r in rows:
            if r.log_ret is not None:
                e = np.exp(-0.5 * (np.log(2 * np.pi * m.var[:, 0]) + (r.log_ret - m.mean[:, 0]) ** 2 / m.var[:, 0]))
                q = (m.start if r.asset not in at else at[r.asset] @ m.move) * e
                at[r.asset] = q / q.sum()
                filtered[k, r.asset, r.ts.timestamp() + 900 * (1, 2, 4)[k]] = at[r.asset]
    for (asset, ts), r in got.items():
        sides = []
        for k in range(3):
            known = [t for j, a, t in filtered if j == k and a == asset and t <= ts.timestamp() + 900]
            if not known:
                assert r.probabilities[k] is None and r.sides[k] is None
                sides.append(None)
                continue
            p = filtered[k, asset, max(known)]
            assert np.allclose(r.probabilities[k], p, atol=1e-9)
            sides.append(r.sides[k])
            assert r.sides[k] == (1, 0, -1)[int(np.argmax(p))]
        assert r.signal == (sides[0] if sides[0] is not None and len(set(sides)) == 1 else 0)
        assert r.decision == {1: "long", -1: "short", 0: "flat"}[r.signal]


SERVICE = '''
def page(asset, start, end, limit):
    return [(t, t, t + 1, t - 1, t, 5) for t in range(start - start % 60000, end + 120000, 60000)][: limit + 2]
'''


def test_candles_as_a_stream(spark, tmp_path, monkeypatch):
    """Two triggers and a restart read what one batch read has, each bar once; an open bar waits."""
    (tmp_path / "candle_service.py").write_text(SERVICE)
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "candle_service.py"))
    clock = str(tmp_path / "now")
    klines.register(spark, lambda: int(open(clock).read()))
    options = {"assets": "a, b", "start": "600000", "step": "60000", "limit": "7", "fetch": "candle_service:page"}
    sink, checkpoint = str(tmp_path / "sink"), str(tmp_path / "checkpoint")
    now = lambda ms: (tmp_path / "now").write_text(str(ms))
    seen = []
    for until in (600000 + 20 * 60000 + 59999, 600000 + 45 * 60000, 600000 + 45 * 60000, 600000 + 51 * 60000 + 1):
        now(until)
        rows = spark.readStream.format("klines").options(**options).load()
        rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(sink).awaitTermination()
        seen.append(spark.read.parquet(sink).count())
    assert seen == [40, 90, 90, 102]
    whole = spark.read.format("klines").options(**options, end=str(600000 + 51 * 60000)).load()
    order = ["asset", F.col("timestamp").cast("long")]
    assert spark.read.parquet(sink).orderBy(*order).collect() == whole.orderBy(*order).collect()

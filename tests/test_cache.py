"""The cache of bars: what is fetched, what is rewritten, failures on the way, clearing."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barloom.sources import cache as C

DAY = dt.datetime(2024, 1, 1)


def at(hours):
    return DAY + dt.timedelta(hours=hours)


def times(spark, *rows):
    return spark.createDataFrame([(a, at(lo), at(hi)) for a, lo, hi in rows], C.TIMES)


def spans(df):
    return sorted((r.asset, (r.since - DAY) / dt.timedelta(hours=1), (r.until - DAY) / dt.timedelta(hours=1)) for r in df.collect())


class Service:
    """Hourly bars at every full hour; notes what it was asked for."""

    def __init__(self, spark):
        self.spark, self.asked, self.fails, self.tag = spark, [], False, 1.0

    def __call__(self, gaps):
        self.asked.append(spans(gaps))
        if self.fails:
            raise ConnectionError
        each = F.explode(F.sequence(F.date_trunc("hour", "since"), "until", F.expr("INTERVAL 1 HOUR"))).alias("ts")
        return gaps.select("asset", each).select("asset", F.col("ts").cast("timestamp_ntz").alias("ts"), *(F.lit(self.tag).alias(c) for c in ("open", "high", "low", "close", "volume")))


@pytest.fixture()
def service(spark):
    return Service(spark)


@pytest.fixture()
def cache(spark, service, tmp_path):
    return C.BarCache(spark, str(tmp_path / "cache"), service)


def test_subtraction_of_times(spark):
    """Intervals that meet, overlap, hold each other or are empty; assets on one side alone."""
    wanted = times(spark, ("a", 0, 10), ("a", 8, 20), ("a", 30, 40), ("b", 0, 5), ("c", 0, 9), ("d", 3, 3))
    had = times(spark, ("a", 2, 4), ("a", 4, 6), ("a", 5, 7), ("a", 19, 31), ("b", 0, 5), ("x", 0, 5), ("c", -5, 1), ("c", 8, 12), ("a", 100, 100))
    assert spans(C.subtract(wanted, had)) == [("a", 0, 2), ("a", 7, 19), ("a", 31, 40), ("c", 1, 8)]
    assert spans(C.subtract(wanted, had.where("false"))) == spans(C.merged(wanted)) and spans(C.subtract(had.where("false"), had)) == []


def test_only_head_and_tail_are_fetched(spark, cache, service, tmp_path):
    odd = "b c/d=e%"
    first = cache.get(times(spark, ("a", 700, 800), (odd, 0, 3)))
    assert Counter(r.asset for r in first.collect()) == {"a": 100, odd: 3} and service.asked == [[("a", 700, 800), (odd, 0, 3)]]
    stamp = lambda: {str(f.relative_to(tmp_path)): f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet") if "bars" in str(f)}
    before, service.tag = stamp(), 2.0
    wide = cache.get(times(spark, ("a", 650, 1500)))
    assert service.asked[1:] == [[("a", 650, 700), ("a", 800, 1500)]]
    rows = {r.ts: r.close for r in wide.collect()}
    assert sorted(rows) == [at(h) for h in range(650, 1500)] and all((rows[at(h)] == 1.0) == (700 <= h < 800) for h in range(650, 1500))
    # January and February of a are rewritten, the other asset's month isn't touched.
    after = stamp()
    assert all(after.get(f) == t for f, t in before.items() if "asset=a" not in f) and len([f for f in before if "asset=a" not in f]) == 1
    assert cache.get(times(spark, ("a", 660, 1400))).count() == 740 and len(service.asked) == 2
    assert cache.get(times(spark, ("a", 660, 670)), refresh=True).select("close").distinct().collect()[0][0] == 2.0 and len(service.asked) == 3


def test_failures_and_retries(spark, cache, service, monkeypatch):
    cache.get(times(spark, ("a", 0, 10)))
    service.fails = True
    with pytest.raises(ConnectionError):
        cache.get(times(spark, ("a", 0, 20)))
    assert spans(cache.coverage()) == [("a", 0, 10)] and cache.bars().count() == 10
    service.fails = False

    def crash(*_):
        raise OSError

    # Bars are written, the coverage isn't: they are fetched and written again, once.
    with monkeypatch.context() as m:
        m.setattr(C.BarCache, "_note", crash)
        with pytest.raises(OSError):
            cache.get(times(spark, ("a", 0, 20)))
    assert spans(cache.coverage()) == [("a", 0, 10)]
    assert cache.get(times(spark, ("a", 0, 20))).count() == 20 == cache.bars().count() and spans(cache.coverage()) == [("a", 0, 20)]
    cache._put(C._within(service(times(spark, ("a", 10, 20))), times(spark, ("a", 10, 20))), times(spark, ("a", 10, 20)))
    assert cache.bars().count() == 20


def test_clearing(spark, cache, service):
    cache.get(times(spark, ("a", 0, 1000), ("b", 0, 10)))
    cache.clear(times(spark, ("a", 100, 2000), ("b", 0, 10)))
    assert spans(cache.coverage()) == [("a", 0, 100)] and Counter(r.asset for r in cache.bars().collect()) == {"a": 100}
    assert cache.get(times(spark, ("b", 0, 10), ("a", 90, 110))).count() == 30 and service.asked[1:] == [[("a", 100, 110), ("b", 0, 10)]]
    cache.clear()
    assert cache.bars().count() == 0 and cache.coverage().count() == 0 and cache.get(times(spark, ("b", 0, 2))).count() == 2

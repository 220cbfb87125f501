"""Every named query of the library against its SQL, or that it runs, on the smallest tables."""

from datetime import datetime, timedelta

import pytest
from util import assert_same, duck

from barloom.functions import windows
from barloom.plans import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, SMALL), ORACLES[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert len(df.columns) == len(set(df.columns)) and df.count() > 0


#: Queries whose operators look back or ahead, or carry values on.
CHUNKED = """rsi indicators_core sma ema distances macd bbands atr roc cci willr adx obv cmf mfi slope ao stoch donchian returns lag_fanout rolling_moments zscore
stability_acf_theta ews_warnings crashes ews_lead_hits warning_intervals fdi entropy hurst_rs hurst_logret vol_of_vol energy rolling_corr fill_limit mtf_macro dashboard_features
asof_backward asof_available asof_rowlimit asof_tolerance asof_forward outer_ffill label_forward label_triple_barrier label_atr_barrier mae_mfe sample_weights sma_cross vector_backtest
sniper_backtest rsi_hysteresis barrier_simulation confirmation_entry mode_smoothing""".split()


@pytest.mark.parametrize("name", CHUNKED)
def test_query_in_small_chunks(spark, name, monkeypatch):
    """Histories of hundreds of rows in chunks of some dozens."""
    monkeypatch.setattr(windows, "CHUNK_ROWS", 60)
    assert_same(QUERIES[name](spark, "/root/testdata/sf0.01"), ORACLES[name], "/root/testdata/sf0.01")


def test_log_returns_of_odd_prices_equal_sql(spark, tmp_path):
    """Hours whose low or close is 0, negative prices, both zeros, NaN, infinities and missing values: limits, not nulls."""
    last = [None if x == "null" else float(x) for x in "1 0 0 5 -3 -2 4 0 -1 -0.0 7 nan 3 inf 2 -inf 6 null 8 1e-300 1e300 -0.0 0 null null 2.5".split()]
    ticks = [(asset, datetime(2024, 1, 1) + timedelta(hours=h, minutes=m), v) for asset in ("a", "b", None) for h, x in enumerate(last) for m, v in ((5, 3.0 if asset == "b" else x), (50, x))]
    # An asset of zeros and ones beside them, so that the other columns of indicators_core have values.
    plain = [("c", datetime(2024, 1, 1) + timedelta(minutes=20 * i), float(v)) for i, v in enumerate("0110231405" * 12)]
    schema = "event_id BIGINT, event_type STRING, ts TIMESTAMP_NTZ, value DOUBLE"
    held = {"returns": ticks + plain, "indicators_core": plain}
    for name, rows in held.items():
        at = str(tmp_path / name)
        spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema).write.parquet(f"{at}/events.parquet")
        assert assert_same(QUERIES[name](spark, at), ORACLES[name], at)
        # assert_same() takes NaN for null.
        for c in {"log_ret", "log_range"} & set(QUERIES[name](spark, at).columns):
            null = duck(at).execute(f"SELECT asset, ts FROM ({ORACLES[name]}) WHERE {c} IS NULL").fetchall()
            got = QUERIES[name](spark, at).where(f"{c} IS NULL").collect()
            assert sorted((str(r.asset), r.ts.isoformat()) for r in got) == sorted((str(a), t.isoformat()) for a, t in null)

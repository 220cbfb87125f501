"""Queries on entries, sizing, policies and backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import accounts, labels, rolling, trading
from barloom.operators.indicators import rsi
from barloom.plans.base import BARS, KEY, Book, lag, lead, roll, steps
from barloom.plans.features import RSI, stability_sql
from barloom.plans.scoring import hits, won
from barloom.sources.bars import resample

q = Book()
QUERIES, ORACLES = q.queries, q.oracles

#: A fixed probability of each bar, from its volume and hour.
P_SQL = "((volume::BIGINT * 7919 + hour(ts) * 104729) % 1000) / 1000.0::DOUBLE AS p"


def with_p(b):
    return b.withColumn("p", F.pmod(F.col("volume").cast("long") * 7919 + F.hour("ts") * 104729, F.lit(1000)) / 1000.0)


_forced = (P_SQL, "(p >= 0.97)::INT AS signal", f"{lead('close', 4)} / nullif(close, 0) - 1 AS f", "max(signal) OVER (PARTITION BY asset, ts::DATE) AS anyone, row_number() OVER (PARTITION BY asset, ts::DATE ORDER BY p DESC, ts) AS n", "anyone = 0 AND n = 1 AS forced")


def _forced_df(b):
    return trading.forced_entry(labels.forward_return(with_p(b), 4).withColumn("signal", (F.col("p") >= 0.97).cast("int")))


@q.on_bars("p signal forced final_signal", steps(*_forced, out="p; =signal; =forced; =CASE WHEN forced THEN 1 ELSE signal END AS final_signal"))
def forced_entry(b):
    return _forced_df(b)


@q.on_bars("n mean_return win_rate", "WITH x AS (" + steps(*_forced, out="=f; =forced") + ") SELECT forced, count(*) AS n, round(avg(f), 6) AS mean_return, round(avg((f > 0)::INT::DOUBLE), 6) AS win_rate FROM x WHERE f IS NOT NULL GROUP BY 1", key="forced")
def forced_entry_perf(b):
    return trading.forced_performance(_forced_df(b))


@q.on_bars("strict moderate continuous", steps(*stability_sql(48, 168), out="CASE WHEN warning THEN 0.0::DOUBLE ELSE 1.0 END AS strict; CASE WHEN warning THEN 0.5::DOUBLE ELSE 1.0 END AS moderate; greatest(0.0::DOUBLE, least(1.0::DOUBLE, (3.0 - coalesce(z_acf, 1.0)) / 2.0)) AS continuous"))
def risk_multiplier(b):
    d = rolling.stability(b, window=48, span=168)
    for mode in ("strict", "moderate", "continuous"):
        d = trading.risk_multiplier(d, mode).withColumnRenamed("size", mode)
    return d


_policy = {"Trend": (0.03, 0.01, 5.0), "Range": (0.015, 0.0075, 3.0), "Stress": (0.01, 0.005, 1.0)}
_regime = "CASE WHEN volume >= 5 THEN 'Stress' WHEN close > open THEN 'Trend' ELSE 'Range' END AS regime"
_case = lambda k: "CASE regime " + " ".join(f"WHEN '{r}' THEN {v[k]}::DOUBLE" for r, v in _policy.items()) + " END"


@q.on_bars("regime tp sl leverage", steps(_regime, f"{_case(0)} AS tp, {_case(1)} AS sl, {_case(2)} AS f", out="=regime; tp; sl; CASE WHEN regime = 'Stress' THEN 1.0::DOUBLE ELSE round(greatest(1.0, least(10.0, 0.01::DOUBLE * f / sl)), 2) END AS leverage"))
def trade_policy(b):
    regime = F.when(F.col("volume") >= 5, "Stress").when(F.col("close") > F.col("open"), "Trend").otherwise("Range")
    return trading.trade_policy(b.withColumn("regime", regime), _policy)


CROSS = (f"{roll('avg', 'close', 10)} AS fa, {roll('avg', 'close', 40)} AS sl", "CASE WHEN fa > sl THEN 1 WHEN fa < sl THEN -1 ELSE 0 END AS signal")


@q.on_bars("signal", steps(*CROSS, out="=signal"))
def sma_cross(b):
    return trading.sma_cross(b, 10, 40)


_states = "CASE WHEN close > open THEN 'Bull' ELSE 'Bear' END AS s1, CASE WHEN volume > 3 THEN 'Bull' WHEN volume < 3 THEN 'Bear' ELSE 'Neutral' END AS s2"


@q.on_bars("signal", steps(_states, out="=CASE WHEN s1 = 'Bull' AND s2 = 'Bull' THEN 1 WHEN s1 = 'Bear' AND s2 = 'Bear' THEN -1 ELSE 0 END AS signal"))
def confluence_signal(b):
    return trading.confluence(_with_states(b), "s1", "s2")


def _with_states(b):
    return b.withColumns({"s1": F.when(F.col("close") > F.col("open"), "Bull").otherwise("Bear"), "s2": F.when(F.col("volume") > 3, "Bull").when(F.col("volume") < 3, "Bear").otherwise("Neutral")})


@q.on_bars("signal", steps(_states, "CASE WHEN hour(ts) < 8 THEN 'Bear' ELSE 'Bull' END AS s3", out="=CASE WHEN s1 = 'Bull' AND s2 = 'Bull' AND s3 = 'Bull' THEN 1 WHEN s1 = 'Bear' AND s2 = 'Bear' AND s3 = 'Bear' THEN -1 ELSE 0 END AS signal"))
def triple_confluence(b):
    return trading.confluence(_with_states(b).withColumn("s3", F.when(F.hour("ts") < 8, "Bear").otherwise("Bull")), "s1", "s2", "s3")


@q.on_bars("state smooth", steps("CASE WHEN close > open THEN 2 WHEN volume > 3 THEN 1 ELSE 0 END AS state", f"list(state) OVER ({KEY} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS l", "[len(list_filter(l, lambda x: x = 0)), len(list_filter(l, lambda x: x = 1)), len(list_filter(l, lambda x: x = 2))] AS c", out="=state; =(list_position(c, list_max(c)) - 1)::INT AS smooth"))
def mode_smoothing(b):
    return rolling.mode_smooth(b.withColumn("state", F.when(F.col("close") > F.col("open"), 2).when(F.col("volume") > 3, 1).otherwise(0)), "state")


_BT = (*CROSS, f"coalesce({lag('signal')}, 0) AS pos, coalesce(ln(close / {lag('close')}), 0) AS ret", f"pos * ret - 0.0006::DOUBLE * abs(pos - coalesce({lag('pos')}, 0)) AS net", f"exp(sum(net) OVER ({KEY})) AS equity", f"equity / max(equity) OVER ({KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd")


def _backtest(b):
    return trading.vector_backtest(trading.sma_cross(b, 10, 40))


@q.on_bars("net log_equity drawdown", steps(*_BT, out="net; ln(equity) AS log_equity; dd AS drawdown"))
def vector_backtest(b):
    return _backtest(b).withColumn("log_equity", F.ln("equity"))


@q.on_bars("n total_return sharpe max_drawdown", "WITH x AS (" + steps(*_BT, out="=net; =equity; =dd") + ") SELECT asset, count(*) AS n, round(last(equity ORDER BY ts) - 1, 6) AS total_return, round(coalesce(avg(net) / CASE WHEN stddev_samp(net) > 1e-12 THEN stddev_samp(net) END * sqrt(8760.0), 0), 6) AS sharpe, round(min(dd), 6) AS max_drawdown FROM x GROUP BY asset", key="asset")
def equity_metrics(b):
    return trading.performance(_backtest(b))


# Sniper entries in 6-hour buckets, by the z-score of hourly closes over 12 hours ------------------------------------------

_SIG = "sig AS (SELECT asset, time_bucket(INTERVAL 6 HOURS, ts) AS signal_ts, CASE WHEN sum(volume) % 3 = 0 THEN 1 WHEN sum(volume) % 3 = 1 THEN -1 ELSE 0 END AS side, first(open ORDER BY ts) AS o, last(close ORDER BY ts) AS exit_price FROM bars GROUP BY asset, time_bucket(INTERVAL 6 HOURS, ts))"
_Z = f"z AS (SELECT *, (close - {roll('avg', 'close', 12)}) / nullif({roll('stddev_samp', 'close', 12)}, 0) AS z FROM bars)"
_ENTRY = f"""{_SIG}, {_Z}, en AS (SELECT s.asset, signal_ts, side, min(ts) AS entry_ts, first(close ORDER BY ts) AS entry_price, first(z ORDER BY ts) AS entry_z, any_value(exit_price) AS exit_price
FROM sig s JOIN z ON s.asset = z.asset AND time_bucket(INTERVAL 6 HOURS, z.ts) = signal_ts WHERE side <> 0 AND (side = 1 AND z <= -0.5 OR side = -1 AND z >= 0.5) GROUP BY 1, 2, 3)"""


def _signals(b):
    s = resample(b, "6 hours")
    k = F.pmod(F.col("volume"), F.lit(3.0))
    return s.select("asset", "ts", F.when(k == 0, 1).when(k == 1, -1).otherwise(0).alias("side"), F.col("open").alias("entry_price"), F.col("close").alias("exit_price"))


def _sniper(b):
    s = _signals(b)
    e = trading.sniper_entries(s, rolling.zscore(b, n=12, name="z"), limit=0.5)
    return e.join(s.select("asset", F.col("ts").alias("signal_ts"), "exit_price"), ["asset", "signal_ts"])


def _naive(b):
    return _signals(b).where("side <> 0").withColumns({"signal_ts": F.col("ts"), "entry_ts": F.col("ts")})


@q.on_bars("side entry_ts entry_price entry_z", f"WITH {BARS}, {_ENTRY} SELECT asset, signal_ts, side, entry_ts, round(entry_price, 6) AS entry_price, round(entry_z, 6) AS entry_z FROM en", key="asset, signal_ts")
def sniper_entry(b):
    return _sniper(b)


def _trades(source: str) -> str:
    left, upto = "1 + 0.1::DOUBLE * net", "OVER (PARTITION BY asset ORDER BY entry_ts)"
    return (
        f"tr AS (SELECT *, side * (exit_price * (1 - side * 0.0002::DOUBLE) / nullif(entry_price * (1 + side * 0.0002::DOUBLE), 0) - 1) - 2 * 0.0006::DOUBLE AS net FROM {source}), "
        f"ru AS (SELECT *, max(coalesce({left} <= 0, false)::INT) {upto} = 1 AS ruined, sum(coalesce(CASE WHEN {left} > 0 THEN ln({left}) END, 0)) {upto} AS logs FROM tr), "
        f"eq AS (SELECT *, CASE WHEN ruined THEN 0 ELSE 10000 * exp(logs) END AS equity FROM ru), dd AS (SELECT *, equity / greatest(10000, max(equity) {upto}) - 1 AS drawdown FROM eq)"
    )


_stats = "SELECT asset, count(*) AS n, last(equity ORDER BY entry_ts) / 10000 - 1 AS total_return, avg((net > 0)::INT::DOUBLE) AS win_rate, min(drawdown) AS max_drawdown, coalesce(avg(net) / CASE WHEN stddev_samp(net) > 1e-12 THEN stddev_samp(net) END * sqrt(count(*)), 0) AS sharpe FROM dd GROUP BY asset"
_NAIVE = "nv AS (SELECT asset, signal_ts, signal_ts AS entry_ts, side, o AS entry_price, exit_price FROM sig WHERE side <> 0)"


@q.on_bars("side net log_equity drawdown ruined", f"WITH {BARS}, {_ENTRY}, {_trades('en')} SELECT asset, signal_ts, side, round(net, 6) AS net, round(ln(nullif(equity, 0)), 6) AS log_equity, round(drawdown, 6) AS drawdown, ruined FROM dd", key="asset, signal_ts")
def sniper_backtest(b):
    return trading.trade_returns(_sniper(b)).withColumn("log_equity", F.ln("equity"))


@q.on_bars("n total_return win_rate max_drawdown sharpe", f"WITH {BARS}, {_SIG}, {_NAIVE}, {_trades('nv')}, st AS ({_stats}) SELECT asset, n, round(total_return, 6) AS total_return, round(win_rate, 6) AS win_rate, round(max_drawdown, 6) AS max_drawdown, round(sharpe, 6) AS sharpe FROM st", key="asset")
def naive_backtest(b):
    return trading.trade_statistics(trading.trade_returns(_naive(b)))


@q.on_bars("n mean_bps median_bps better", f"""WITH {BARS}, {_ENTRY}, {_NAIVE}, d AS (SELECT en.asset, en.side * (nv.entry_price - en.entry_price) / nv.entry_price * 10000 AS bps FROM en JOIN nv ON en.asset = nv.asset AND en.signal_ts = nv.signal_ts)
SELECT asset, count(*) AS n, round(avg(bps), 6) AS mean_bps, round(quantile_cont(bps, 0.5), 6) AS median_bps, round(avg((bps > 0)::INT::DOUBLE), 6) AS better FROM d GROUP BY asset""", key="asset")
def entry_improvement(b):
    return trading.entry_improvement(_sniper(b), _naive(b))


#: Returns of some hundred million times: three places are as many as doubles of two engines agree on.
@q.on_bars("total_return_gain sharpe_gain max_drawdown_gain return_to_drawdown", f"""WITH {BARS}, {_ENTRY}, {_NAIVE}, a AS (WITH {_trades('nv')} {_stats}), b AS (WITH {_trades('en')} {_stats})
SELECT asset, round(b.total_return - a.total_return, 3) AS total_return_gain, round(b.sharpe - a.sharpe, 3) AS sharpe_gain, round(b.max_drawdown - a.max_drawdown, 3) AS max_drawdown_gain, round(b.total_return / nullif(abs(b.max_drawdown), 0), 3) AS return_to_drawdown FROM a JOIN b USING (asset)""", key="asset", digits=3)
def strategy_comparison(b):
    st = lambda t: trading.trade_statistics(trading.trade_returns(t))
    return trading.strategies(st(_naive(b)), st(_sniper(b)))


@q.on_bars("position", steps(*RSI, "CASE WHEN rsi_14 < 40 THEN 1 WHEN rsi_14 > 55 THEN 0 END AS e", f"coalesce(last_value(e IGNORE NULLS) OVER ({KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS position", out="=position"))
def rsi_hysteresis(b):
    return trading.hysteresis(rsi(b), buy=40, sell=55)


def _account(size: str, *parts: str, start: float = 10_000.0, stake: float = 1_000.0) -> str:
    """An account bar by bar; size: what the stake of an order is multiplied by."""
    bars = steps(*RSI, *parts, f"coalesce({size}, 0) AS scale", out="=close; =rsi_14; =scale")
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, {stake}::DOUBLE * scale AS amount, row_number() OVER (PARTITION BY asset ORDER BY ts) AS n FROM ({bars})), acc AS (
  SELECT DISTINCT asset, NULL::TIMESTAMP AS ts, 0::BIGINT AS n, 0.0::DOUBLE AS close, {start}::DOUBLE AS cash, 0.0::DOUBLE AS units, 0::BIGINT AS n_trades, 0::BIGINT AS skipped, 0::BIGINT AS refused FROM e
  UNION ALL
  SELECT asset, ts, n, close, CASE WHEN wants AND pays THEN cash - amount WHEN sells THEN cash + units * close ELSE cash END, CASE WHEN wants AND pays THEN amount / close WHEN sells THEN 0.0::DOUBLE ELSE units END,
    n_trades + (wants AND pays)::BIGINT, skipped + passes::BIGINT, refused + (wants AND NOT pays)::BIGINT
  FROM (SELECT e.asset, e.ts, e.n, e.close, cash, units, amount, n_trades, skipped, refused, coalesce(units = 0 AND rsi_14 < 40 AND amount > 0, false) AS wants, cash >= amount AND e.close > 0 AS pays,
          coalesce(units = 0 AND rsi_14 < 40 AND amount <= 0, false) AS passes, coalesce(units > 0 AND rsi_14 > 55, false) AS sells FROM acc JOIN e ON e.asset = acc.asset AND e.n = acc.n + 1)
)
SELECT asset, ts, (units > 0)::INT AS position, round(cash, 6) AS cash, round(cash + units * close, 6) AS equity, n_trades, skipped, refused FROM acc WHERE n > 0"""


_ACCOUNT = "position cash equity n_trades skipped refused"


@q.on_bars(_ACCOUNT, _account("1.0::DOUBLE"))
def rsi_account(b):
    return accounts.guarded(rsi(b), buy=40, sell=55)


@q.on_bars(_ACCOUNT, _account("size", *stability_sql(48, 168), "CASE WHEN warning THEN 0.0::DOUBLE ELSE 1.0 END AS size"))
def rsi_account_scaled(b):
    d = trading.risk_multiplier(rolling.stability(rsi(b), window=48, span=168), "strict")
    return accounts.guarded(d, buy=40, sell=55, size="size")


#: Sizes that differ from bar to bar, in an account that can't pay for most of them.
_SIZES = "(volume::BIGINT % 4) / 2.0::DOUBLE AS size"


@q.on_bars(_ACCOUNT, _account("size", _SIZES, start=1_200.0))
def rsi_account_tight(b):
    """The guard binds: orders of 0, 500, 1,000 and 1,500 with 1,200 to begin with."""
    return accounts.guarded(rsi(b).withColumn("size", F.col("volume").cast("long") % 4 / 2), buy=40, sell=55, start=1_200.0, size="size", every="5 days")


@q.on_bars("label pnl log_balance", "WITH x AS (" + steps(*hits("close * (1 + 2.0::DOUBLE)", "close * (1 - 0.5::DOUBLE)", 36), f"{won(36)} AS label", "0.01::DOUBLE * CASE WHEN label = 1 THEN 2.0 ELSE -0.5 END AS pnl", out="=label; =pnl", where="label IS NOT NULL") + ") SELECT asset, ts, label, round(pnl, 6) AS pnl, round(ln(10000) + sum(ln(1 + pnl)) OVER (PARTITION BY asset ORDER BY ts), 6) AS log_balance FROM x")
def barrier_simulation(b):
    return trading.barrier_simulation(labels.triple_barrier(b, 2.0, 0.5), 2.0, 0.5, 0.01).withColumn("log_balance", F.ln("balance"))


@q.on_bars("side scenario entry_ts entry_price", "WITH x AS (" + steps(*CROSS, f"{lead('ts')} AS t1, {lead('open')} AS o1, {lead('close')} AS c1, {lead('ts', 2)} AS t2, {lead('open', 2)} AS o2", "sign(c1 - o1) = signal AS yes", out="=signal; =t1; =c1; =t2; =o2; =yes", where="signal <> 0") + ") SELECT * FROM (SELECT asset, ts, signal AS side, CASE WHEN yes THEN 'A' ELSE 'B' END AS scenario, CASE WHEN yes THEN t1 ELSE t2 END AS entry_ts, round(CASE WHEN yes THEN c1 ELSE o2 END, 6) AS entry_price FROM x) WHERE entry_ts IS NOT NULL")
def confirmation_entry(b):
    s = trading.sma_cross(b, 10, 40).select("asset", "ts", F.col("signal").alias("side"))
    return trading.confirmation(s, b)


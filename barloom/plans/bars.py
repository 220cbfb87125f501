"""Queries on sources: bars, caches, dedup, checks, joins of panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.windows import chunked, with_lookback
from barloom.operators import joins
from barloom.operators.indicators import sma
from barloom.plans.base import BARS, KEY, Book, lag, pick, roll, scratch, steps
from barloom.sources import bars as B
from barloom.sources import quality

q = Book()
QUERIES, ORACLES = q.queries, q.oracles


@q.on_bars("open high low close volume", steps(out="open; high; low; close; volume"))
def bars_hourly(b):
    return b


@q("""
SELECT l_returnflag AS asset, l_shipdate AS ts, round(first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber), 6) AS open, round(max(l_extendedprice / l_quantity), 6) AS high,
       round(min(l_extendedprice / l_quantity), 6) AS low, round(last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber), 6) AS close, round(sum(l_quantity), 6) AS volume
FROM lineitem GROUP BY 1, 2
""")
def bars_daily_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return pick(B.bars(t, "l_returnflag", F.col("l_extendedprice") / F.col("l_quantity"), "l_shipdate", "1 day", ["l_orderkey", "l_linenumber"], F.col("l_quantity")), "open high low close volume")


@q("""
SELECT o_orderpriority AS asset, o_orderdate AS ts, round(first(o_totalprice ORDER BY o_orderkey), 6) AS open, round(max(o_totalprice), 6) AS high, round(min(o_totalprice), 6) AS low,
       round(last(o_totalprice ORDER BY o_orderkey), 6) AS close, round(count(*)::DOUBLE, 6) AS volume
FROM orders GROUP BY 1, 2
""")
def bars_daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return pick(B.bars(t, "o_orderpriority", "o_totalprice", "o_orderdate", "1 day", ["o_orderkey"]), "open high low close volume")


@q.on_bars("open high low close volume", f"""
WITH {BARS} SELECT asset, time_bucket(INTERVAL 6 HOURS, ts) AS ts, round(first(open ORDER BY ts), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low,
  round(last(close ORDER BY ts), 6) AS close, round(sum(volume), 6) AS volume FROM bars GROUP BY 1, time_bucket(INTERVAL 6 HOURS, ts)
""")
def bars_resampled(b):
    return B.resample(b, "6 hours")


@q.on_bars("rows null_ts repeated_ts early_ts first_ts last_ts", f"""
WITH {BARS} SELECT asset, count(*) AS rows, count(*) FILTER (ts IS NULL) AS null_ts, count(ts) - count(DISTINCT ts) AS repeated_ts,
  count(*) FILTER (ts < TIMESTAMP '2010-01-01') AS early_ts, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY 1
""", key="asset")
def time_validation(b):
    return quality.time_report(b)


@q.on_bars("steps share grade", f"""
WITH {BARS}, d AS (SELECT asset, date_diff('second', {lag('ts')}, ts) AS s FROM bars), g AS (SELECT asset, count(s) AS steps, avg((s = 3600)::INT::DOUBLE) AS share FROM d GROUP BY 1)
SELECT asset, steps, round(share, 6) AS share, CASE WHEN share >= 0.95 THEN 'good' WHEN share >= 0.9 THEN 'fair' ELSE 'poor' END AS grade FROM g
""", key="asset")
def interval_consistency(b):
    return quality.interval_report(b, 3600)


_null = ", ".join(f"count(*) FILTER ({c} IS NULL) AS null_{c}" for c in ("open", "high", "low", "close", "volume"))
_bad = ", ".join(f"count(*) FILTER ({c} <= 0) AS bad_{c}" for c in ("open", "high", "low", "close"))


@q.on_bars(
    "rows null_open null_high null_low null_close null_volume bad_open bad_high bad_low bad_close bad_high_low bad_low_high zero_volume negative_volume",
    f"""WITH {BARS} SELECT asset, count(*) AS rows, {_null}, {_bad}, count(*) FILTER (high < greatest(open, close)) AS bad_high_low, count(*) FILTER (low > least(open, close)) AS bad_low_high,
    count(*) FILTER (volume = 0) AS zero_volume, count(*) FILTER (volume < 0) AS negative_volume FROM bars GROUP BY 1""", key="asset",
)
def quality_report(b):
    return quality.ohlc_report(b)


_dedup = "SELECT event_type, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY {o}) AS n FROM events) WHERE n = 1"


def _one(spark, sf_dir, *order):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("_h", F.window("ts", "1 hour")["start"])
    return B.keep_one(e, ["event_type", "_h"], order).select("event_type", "ts", "event_id", "value")


@q(_dedup.format(o="ts, event_id"))
def dedup_keep_first(spark, sf_dir):
    return _one(spark, sf_dir, F.col("ts"), F.col("event_id"))


@q(_dedup.format(o="ts DESC, event_id DESC"))
def dedup_keep_last(spark, sf_dir):
    return _one(spark, sf_dir, F.col("ts").desc(), F.col("event_id").desc())


@q.on_bars("close", f"""
WITH {BARS}, o AS (SELECT asset, ts, close FROM bars WHERE hour(ts) < 16), n AS (SELECT asset, ts, close + 1 AS close FROM bars WHERE hour(ts) >= 8)
SELECT asset, ts, round(close, 6) AS close FROM (SELECT * FROM o UNION ALL SELECT * FROM n WHERE (asset, ts) NOT IN (SELECT (asset, ts) FROM o))
""")
def upsert_bars(b):
    return B.upsert(b.where(F.hour("ts") < 16).select("asset", "ts", "close"), b.where(F.hour("ts") >= 8).select("asset", "ts", (F.col("close") + 1).alias("close")))


@q("SELECT event_id, ts, value FROM events WHERE ts BETWEEN (SELECT min(ts) FROM events) + INTERVAL 3 DAYS AND (SELECT max(ts) FROM events) - INTERVAL '2 days 6 hours 30 minutes'")
def range_filter(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "value")
    lo, hi = e.agg(F.min("ts") + F.expr("INTERVAL 3 DAYS"), B.lookback(F.max("ts"), 2, 6, 30)).first()
    return B.between(e, lo, hi)


@q.on_bars("close", f"WITH {BARS} SELECT asset, ts, round(close, 6) AS close FROM bars WHERE asset IN ('click', 'view', 'purchase') UNION ALL SELECT 'copy' AS asset, ts, round(close, 6) AS close FROM bars WHERE asset = 'click'")
def union_assets(b):
    b = b.select("asset", "ts", "close")
    mine = b.where(F.col("asset").isin("click", "view", "purchase"))
    return mine.unionByName(B.union({"copy": b.where("asset = 'click'")}))


@q.on_bars("close", f"""
WITH {BARS}, e AS (SELECT max(a) AS f, min(b) AS t FROM (SELECT min(ts) AS a, max(ts) AS b FROM bars GROUP BY asset))
SELECT asset, ts, round(close, 6) AS close FROM bars, e WHERE ts BETWEEN f AND t
""")
def common_period(b):
    return joins.common_period(b)


@q.on_bars("sma_24", f"WITH {BARS}, s AS (SELECT asset, ts, round({roll('avg', 'close', 24)}, 6) AS sma_24 FROM bars), m AS (SELECT min(ts) AS a FROM bars) SELECT s.* FROM s, m WHERE ts >= TIMESTAMP '2024-01-10'")
def lookback_filter(b):
    return with_lookback(b, lambda d: sma(d, (24,)), "2024-01-10", "2100-01-01", "10 DAYS")


@q.on_bars("sma_200", steps(f"{roll('avg', 'close', 200)} AS a", out="a AS sma_200"))
def sma_chunked(b):
    """A long history in chunks of 250 rows with a halo of 199."""
    return chunked(b, lambda d, by: sma(d, (200,), by=by), 199, rows=250)


_MACRO = "macro AS (SELECT asset, time_bucket(INTERVAL 6 HOURS, ts) AS ts, last(close ORDER BY ts) AS macro_close FROM bars GROUP BY 1, time_bucket(INTERVAL 6 HOURS, ts))"


def _macro(b):
    return B.resample(b, "6 hours").select("asset", "ts", F.col("close").alias("macro_close"))


@q.on_bars("close macro_close", f"WITH {BARS}, {_MACRO} SELECT b.asset, b.ts, round(b.close, 6) AS close, round(macro_close, 6) AS macro_close FROM bars b ASOF LEFT JOIN macro m ON b.asset = m.asset AND b.ts >= m.ts")
def asof_backward(b):
    return joins.asof(b.select("asset", "ts", "close"), _macro(b), ["macro_close"])


@q.on_bars("macro_close", f"WITH {BARS}, {_MACRO}, n AS (SELECT asset, ts + INTERVAL 6 HOURS AS ts, macro_close FROM macro) SELECT b.asset, b.ts, round(macro_close, 6) AS macro_close FROM bars b ASOF LEFT JOIN n m ON b.asset = m.asset AND b.ts >= m.ts")
def asof_available(b):
    return joins.asof(b.select("asset", "ts"), _macro(b), ["macro_close"], available="6 HOURS")


@q.on_bars("macro_close", f"""
WITH {BARS}, {_MACRO}, j AS (SELECT b.asset, b.ts, m.ts AS mts, macro_close FROM bars b ASOF LEFT JOIN macro m ON b.asset = m.asset AND b.ts >= m.ts),
k AS (SELECT *, row_number() OVER (PARTITION BY asset, mts ORDER BY ts) AS n FROM j) SELECT asset, ts, CASE WHEN n <= 3 THEN round(macro_close, 6) END AS macro_close FROM k
""")
def asof_rowlimit(b):
    return joins.asof(b.select("asset", "ts"), _macro(b), ["macro_close"], max_rows=3)


@q.on_bars("macro_close", f"""
WITH {BARS}, {_MACRO} SELECT b.asset, b.ts, CASE WHEN m.ts >= b.ts - INTERVAL 2 HOURS THEN round(macro_close, 6) END AS macro_close FROM bars b ASOF LEFT JOIN macro m ON b.asset = m.asset AND b.ts >= m.ts
""")
def asof_tolerance(b):
    return joins.asof(b.select("asset", "ts"), _macro(b), ["macro_close"], tolerance="2 HOURS")


@q.on_bars("macro_close", f"WITH {BARS}, {_MACRO} SELECT b.asset, b.ts, round(macro_close, 6) AS macro_close FROM bars b ASOF LEFT JOIN macro m ON b.asset = m.asset AND b.ts <= m.ts")
def asof_forward(b):
    return joins.asof(b.select("asset", "ts"), _macro(b), ["macro_close"], forward=True)


@q.on_bars("a b", f"""
WITH {BARS}, x AS (SELECT asset, ts, close AS a FROM bars WHERE hour(ts) % 2 = 0), y AS (SELECT asset, ts, volume AS b FROM bars WHERE hour(ts) % 3 = 0),
j AS (SELECT asset, ts, a, b FROM x FULL JOIN y USING (asset, ts))
SELECT asset, ts, round(last_value(a IGNORE NULLS) OVER w, 6) AS a, round(last_value(b IGNORE NULLS) OVER w, 6) AS b FROM j WINDOW w AS ({KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def outer_ffill(b):
    x = b.where(F.hour("ts") % 2 == 0).select("asset", "ts", F.col("close").alias("a"))
    y = b.where(F.hour("ts") % 3 == 0).select("asset", "ts", F.col("volume").alias("b"))
    return joins.outer_fill(x, y, ["asset", "ts"], ["a", "b"])


@q.on_bars("click view purchase", f"""
WITH {BARS} SELECT * FROM (SELECT ts, round(max(close) FILTER (asset = 'click'), 6) AS click, round(max(close) FILTER (asset = 'view'), 6) AS view, round(max(close) FILTER (asset = 'purchase'), 6) AS purchase FROM bars GROUP BY ts)
WHERE click IS NOT NULL AND view IS NOT NULL AND purchase IS NOT NULL
""", key="ts")
def pivot_intersection(b):
    return joins.wide(b, "close", ["click", "view", "purchase"], complete=True)


@q.on_bars("volatility efficiency pressure max_drawdown range_ratio consistency n", f"""
WITH {BARS}, l AS (SELECT *, make_timestamp((ceil(epoch(ts) / 21600.0) * 21600)::BIGINT * 1000000) AS b FROM bars),
d AS (SELECT *, close - lag(close) OVER w AS d, max(high) OVER (PARTITION BY asset, b ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM l WINDOW w AS (PARTITION BY asset, b ORDER BY ts)),
g AS (SELECT asset, b AS ts, count(*) AS n, stddev_samp(d / nullif(close - d, 0)) AS vol, first(close ORDER BY ts) AS f, last(close ORDER BY ts) AS l, sum(abs(d)) AS path,
  sum(CASE WHEN close > open THEN volume ELSE 0 END) AS up, sum(CASE WHEN close < open THEN volume ELSE 0 END) AS dn, max((top - low) / nullif(top, 0)) AS mdd, max(high) AS hi, min(low) AS lo,
  avg(CASE WHEN d > 0 THEN 1.0 WHEN d IS NOT NULL THEN 0.0 END) AS rise FROM d GROUP BY 1, 2)
SELECT asset, ts, n, round(coalesce(vol, 0), 6) AS volatility, round(coalesce(least(abs(l - f) / nullif(path, 0), 1), 0), 6) AS efficiency, round((up + 1) / (dn + 1), 6) AS pressure,
  round(coalesce(mdd, 0), 6) AS max_drawdown, round(coalesce((hi - lo) / nullif(l, 0), 0), 6) AS range_ratio, round(coalesce(rise, 0.5), 6) AS consistency FROM g
""")
def microstructure_right(b):
    return joins.micro_right(b)


@q.on_bars("micro_range micro_volume_cv micro_return micro_std", f"""
WITH {BARS}, g AS (SELECT asset, time_bucket(INTERVAL 6 HOURS, ts) AS b, max(high) AS h, min(low) AS l, last(close ORDER BY ts) AS c, first(open ORDER BY ts) AS o, avg(volume) AS v, stddev_samp(volume) AS sv, stddev_samp(close) AS s FROM bars GROUP BY 1, 2)
SELECT asset, b AS ts, round((h - l) / nullif(c, 0), 6) AS micro_range, round(sv / nullif(v, 0), 6) AS micro_volume_cv, round((c - o) / nullif(o, 0), 6) AS micro_return, round(s, 6) AS micro_std FROM g
""")
def microstructure_floor(b):
    return joins.micro_floor(b)


@q.on_bars("bar_ts close", f"""
WITH {BARS}, s AS (SELECT asset, time_bucket(INTERVAL 6 HOURS, ts) AS b FROM bars GROUP BY 1, 2)
SELECT s.asset, s.b AS signal_ts, ts AS bar_ts, round(close, 6) AS close FROM s JOIN bars ON bars.asset = s.asset AND bars.ts >= s.b AND bars.ts < s.b + INTERVAL 6 HOURS
""", key="asset, signal_ts")
def interval_join(b):
    s = B.resample(b, "6 hours").select("asset", "ts")
    return joins.first_hour_bars(s, b.select("asset", "ts", "close"), "6 hours").withColumnRenamed("ts", "bar_ts")


@q.on_bars("metric n mean std least q25 median q75 most", f"""
WITH {BARS}, l AS (SELECT asset, 'close' AS metric, close AS v FROM bars UNION ALL SELECT asset, 'volume' AS metric, volume AS v FROM bars)
SELECT asset, metric, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS least, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median,
  round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS most FROM l GROUP BY 1, 2
""", key="asset")
def profiler_summary(b):
    from barloom.operators.rolling import profile

    return profile(b, ["close", "volume"])


@q.on_bars("mean_a mean_b difference percent", f"""
WITH {BARS}, l AS (SELECT asset, 'close' AS metric, close AS v FROM bars UNION ALL SELECT asset, 'volume' AS metric, volume AS v FROM bars),
m AS (SELECT metric, avg(v) FILTER (asset = 'click') AS a, avg(v) FILTER (asset = 'view') AS b FROM l GROUP BY 1)
SELECT metric, round(a, 6) AS mean_a, round(b, 6) AS mean_b, round(b - a, 6) AS difference, round(100 * (b - a) / nullif(abs(a), 0), 6) AS percent FROM m
""", key="metric")
def profile_compare(b):
    from barloom.operators.rolling import compare, profile

    return compare(profile(b, ["close", "volume"]), "click", "view")



@q.on_bars("close", f"WITH {BARS} SELECT asset, ts, round(close, 6) AS close FROM bars QUALIFY row_number() OVER (PARTITION BY asset ORDER BY ts DESC) <= 100")
def latest_bars(b):
    return B.latest(b, 100)


@q.on_bars("open high low close volume", f"WITH {BARS} SELECT asset, ts, open, high, low, close, CASE WHEN volume <> 2 THEN volume END AS volume FROM bars")
def klines_parse(b):
    """Bars as an exchange sends them (texts, epoch milliseconds, some of them bad), read again."""
    text = {c: F.col(c).cast("string") for c in ("open", "high", "low", "close")}
    raw = b.withColumn("timestamp", F.expr("CAST(timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01', ts) AS STRING)")).withColumns(text)
    return B.from_klines(raw.withColumn("volume", F.when(F.col("volume") == 2, "n/a").otherwise(F.col("volume").cast("string"))))


_ALL = f"WITH {BARS} SELECT asset, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars"


def _through(form: str, read):
    def query(spark, sf_dir):
        path = scratch(spark)
        B.write(B.event_bars(spark, sf_dir).select("asset", "ts", "open", "high", "low", "close", "volume"), path, form)
        return pick(read(spark, path).select("asset", "ts", "open", "high", "low", "close", "volume"), "open high low close volume")

    query.__name__ = f"{form}_files"
    query.__doc__ = f"Bars written as {form} files and read again."
    return q(_ALL)(query)


_through("csv", B.read_csv)
_through("json", lambda spark, path: B.read_json(spark, path, B.SCHEMA))
_through("parquet", B.read_parquet)


@q("SELECT 'A' || (k // 1000) AS asset, TIMESTAMP '2024-01-01' + to_hours((k % 1000)::INT) AS ts, true AS whole FROM range(0, 3000) g(k)")
def synthetic_bars(spark, sf_dir):
    """Seeded walks; the SQL knows their keys and that each bar holds together."""
    b = B.synthetic(spark)
    whole = (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close")) & (F.col("low") > 0) & (F.col("volume") >= 0)
    return b.select("asset", "ts", whole.alias("whole"))


@q(f"WITH {BARS}, x AS (SELECT *, min(ts) OVER (PARTITION BY asset) AS t FROM bars) SELECT asset, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM x WHERE ts >= t + INTERVAL 24 HOURS AND ts < t + INTERVAL 240 HOURS AND (asset <> 'click' OR ts < t + INTERVAL 200 HOURS)")
def cached_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars by way of a cache: a range in the middle is asked for first, so the second request fetches a head and a tail for each asset."""
    from barloom.sources.cache import BarCache

    whole = B.event_bars(spark, sf_dir)
    begin = whole.groupBy("asset").agg(F.min("ts").alias("t"))
    times = lambda a, b: begin.select("asset", *((F.col("t") + F.expr(f"INTERVAL {h} HOURS")).alias(n) for n, h in (("since", a), ("until", b))))
    cache = BarCache(spark, scratch(spark), lambda gaps: whole.join(gaps, "asset").where("ts >= since AND ts < until"))
    cache.get(times(72, 150))
    short = times(24, 240).where("asset <> 'click'").unionByName(times(24, 200).where("asset = 'click'"))
    return pick(cache.get(short), "open high low close volume")

"""Rolling windows with a full-window guard, two-level running sums, recursive averages and time-chunking.

Assets are few and histories long, so no task holds a whole history: running values work in two levels, and what looks
back or ahead by a bounded number of rows works in chunks with a halo (`bounded` operators do so by themselves).
"""

from __future__ import annotations

import functools
import inspect
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Guards divisions in the indicators.
EPS = 1e-10


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


class Roll:
    """Functions over the rows of a key in order of time; rolling ones are null until the window is full."""

    def __init__(self, by: Sequence[str] = ("asset",), order: Sequence[str] = ("ts",)):
        self.w = W.partitionBy(*by).orderBy(*order)

    def lag(self, x, n: int = 1) -> Column:
        return F.lag(col(x), n).over(self.w)

    def lead(self, x, n: int = 1) -> Column:
        return F.lead(col(x), n).over(self.w)

    def frame(self, n: int, end: int = 0):
        return self.w.rowsBetween(end - n + 1, end)

    def agg(self, x, n: int, f: Callable[[Column], Column], least: int | None = None, end: int = 0) -> Column:
        """f of the last n rows up to `end`, null unless `least` (n by default) of them have x."""
        frame = self.frame(n, end)
        return F.when(F.count(col(x)).over(frame) >= (n if least is None else least), f(col(x)).over(frame))

    def mean(self, x, n: int, **k) -> Column:
        return self.agg(x, n, F.avg, **k)

    def sum(self, x, n: int, **k) -> Column:
        return self.agg(x, n, F.sum, **k)

    def min(self, x, n: int, **k) -> Column:
        return self.agg(x, n, F.min, **k)

    def max(self, x, n: int, **k) -> Column:
        return self.agg(x, n, F.max, **k)

    def std(self, x, n: int, **k) -> Column:
        return self.agg(x, n, F.stddev_samp, **k)

    def number(self) -> Column:
        return F.row_number().over(self.w)

    def last(self, x, n: int | None = None) -> Column:
        """The latest non-null x, of the last n rows if n is given."""
        frame = self.w.rowsBetween(W.unboundedPreceding if n is None else -n, 0)
        return F.last(col(x), ignorenulls=True).over(frame)


def ratio(a, b) -> Column:
    """a / b; null if b is 0."""
    return F.try_divide(col(a), col(b))


def clip(x, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(x)))


def by_time(ts: str, every: str) -> Column:
    """The start of ts's bucket of that length."""
    return F.window(F.col(ts), every)["start"]


def bucket_of(df: DataFrame, ts: str, every: str) -> Column:
    """The bucket of a row's time, or of its number where ts is one (by 1,024); rows without have the first one."""
    kind = df.schema[ts].dataType
    if isinstance(kind, T.NumericType):
        return F.floor(F.coalesce(F.col(ts), F.lit(0)) / 1024)
    return F.window(F.coalesce(F.col(ts).cast("timestamp_ntz"), F.lit("1970-01-01").cast("timestamp_ntz")), every)["start"]


def running(df: DataFrame, values: dict[str, tuple[Column, str]], by: Sequence[str] = ("asset",), ts: str = "ts", every: str = "1 day", then: Sequence[str] = (), down: bool = False) -> DataFrame:
    """df with running values of each key: name -> (column, "sum", "max", "last", which is the latest non-null, or "peak", the highest sum so far).

    Worked out in two levels: within the row's time bucket, and what the earlier buckets come to. A task holds one
    bucket of a key; windows over a whole key see one row per bucket. Rows are in order of ts and the columns `then`,
    or the reverse (down). Rows without a time come first.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    inner = lambda name: f"_x_{name}"
    held = df.withColumns({inner(n): x for n, (x, _) in values.items()} | {"_bucket": bucket_of(df, ts, every)})
    at = F.struct(ts, *then)
    turn = (lambda c: F.col(c).desc()) if down else F.col
    pick = F.min_by if down else F.max_by
    within = W.partitionBy(*by, "_bucket").orderBy(*map(turn, (ts, *then))).rowsBetween(W.unboundedPreceding, 0)
    peaks = [n for n, (_, kind) in values.items() if kind == "peak"]
    if peaks:
        held = held.withColumns({f"_s_{n}": F.sum(inner(n)).over(within) for n in peaks})
    whole = {"sum": lambda c: F.sum(c), "max": lambda c: F.max(c), "last": lambda c: pick(c, F.when(F.col(c).isNotNull(), at)), "peak": lambda c: F.sum(c)}
    sums = held.groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col("_bucket").alias("_kb")).agg(*(whole[kind](inner(n)).alias(inner(n)) for n, (_, kind) in values.items()), *(F.max(f"_s_{n}").alias(f"_s_{n}") for n in peaks))
    over = {"sum": F.sum, "peak": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    before = W.partitionBy(*keys).orderBy(turn("_kb")).rowsBetween(W.unboundedPreceding, -1)
    # A bucket's peak is counted from its start, which is what the buckets before it come to.
    sums = sums.withColumns({f"_s_{n}": F.col(f"_s_{n}") + F.coalesce(F.sum(inner(n)).over(before), F.lit(0)) for n in peaks})
    sums = sums.select(*keys, "_kb", *(F.max(f"_s_{n}").over(before).alias(f"_p_{n}") for n in peaks), *(over[kind](inner(n)).over(before).alias(f"_b_{n}") for n, (_, kind) in values.items()))
    same = F.col("_bucket") == F.col("_kb")
    for c, k in zip(by, keys, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    both = {
        "sum": lambda n: over["sum"](inner(n)).over(within) + F.coalesce(F.col(f"_b_{n}"), F.lit(0)), "max": lambda n: F.greatest(over["max"](inner(n)).over(within), F.col(f"_b_{n}")),
        "last": lambda n: F.coalesce(over["last"](inner(n)).over(within), F.col(f"_b_{n}")),
        "peak": lambda n: F.greatest(F.max(f"_s_{n}").over(within) + F.coalesce(F.col(f"_b_{n}"), F.lit(0)), F.col(f"_p_{n}")),
    }
    out = held.join(sums, same).withColumns({n: both[kind](n) for n, (_, kind) in values.items()})
    return out.drop("_bucket", "_kb", *keys, *map(inner, values), *(f"_b_{n}" for n in values), *(f"_{x}_{n}" for n in peaks for x in "sp"))


def running_sum(df: DataFrame, x: Column, name: str, by: Sequence[str] = ("asset",), ts: str = "ts", every: str = "1 day") -> DataFrame:
    """df with the sum of x up to each row of its key."""
    return running(df, {name: (x, "sum")}, by, ts, every)


def faded(span: int) -> int:
    """Rows after which a value's weight in an exponential average is below 1e-18."""
    q = 1 - 2 / (span + 1)
    return math.ceil(41.5 / -math.log(q)) if q > 0 else 1


def ema(df: DataFrame, spans: dict[str, tuple[str, int]], by: Sequence[str] = ("asset",), ts: str = "ts", block: int = 64) -> DataFrame:
    """df with exponential averages: name -> (column, span); alpha = 2 / (span + 1), seeded with the first value.

    Only values count: the average is null before the first and stays as it is where the column is null or NaN. A span of 1
    copies. In chunks, with as many rows before each as it takes for the weight of the first to fall below 1e-18.
    """
    if CHUNK in by:
        return _ema(df, spans, by, ts, block)
    return chunked(df, lambda d, keys: _ema(d, spans, keys, ts, block), max(faded(n) for _, n in spans.values()), by, ts)


def _ema(df: DataFrame, spans: dict[str, tuple[str, int]], by: Sequence[str], ts: str, block: int) -> DataFrame:
    """The recurrence is linear, so it is worked out in blocks of values: sums within a block, then the ends of the blocks
    before, back to where their weight is below 1e-18. Nothing leaves the JVM."""
    so_far = W.partitionBy(*by).orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    out = df
    for x in dict.fromkeys(x for x, _ in spans.values()):
        own = {name: 1 - 2 / (span + 1) for name, (y, span) in spans.items() if y == x}
        value = F.col(x).cast("double")
        value = F.when(~F.isnan(value), value)
        out = out.withColumns({name: F.last(value, ignorenulls=True).over(so_far) for name, q in own.items() if not q})
        own = {name: q for name, q in own.items() if q}
        if not own:
            continue
        held = out.withColumn("_ema_n", F.count(value).over(so_far) - 1).withColumns({"_ema_block": F.floor(F.col("_ema_n") / block), "_ema_k": F.col("_ema_n") % block})
        in_block = W.partitionBy(*by, "_ema_block").orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
        for name, q in own.items():
            weight = F.when(F.col("_ema_n") == 0, 1.0).otherwise(1 - q) * F.pow(F.lit(q), -F.col("_ema_k"))
            held = held.withColumn(f"_in_{name}", F.coalesce(F.sum(value * weight).over(in_block), F.lit(0.0)) * F.pow(F.lit(q), F.col("_ema_k")))
        last = held.groupBy(*by, "_ema_block").agg(*(F.max_by(f"_in_{n}", "_ema_k").alias(f"_end_{n}") for n in own))
        over = W.partitionBy(*by).orderBy("_ema_block")

        def fold(name: str, q: float, over=over) -> Column:
            m = max(1, math.ceil(41.5 / (-block * math.log(q))))
            return F.aggregate(F.collect_list(f"_end_{name}").over(over.rowsBetween(-m, -1)), F.lit(0.0), lambda s, e: s * q**block + e).alias(f"_to_{name}")

        carried = last.select(*by, "_ema_block", *(fold(n, q) for n, q in own.items()))
        both = held.join(carried, [*by, "_ema_block"])
        out = both.withColumns({n: F.when(F.col("_ema_n") >= 0, F.col(f"_in_{n}") + F.col(f"_to_{n}") * F.pow(F.lit(q), F.col("_ema_k") + 1)) for n, q in own.items()})
        out = out.select(*(c for c in out.columns if c not in {"_ema_n", "_ema_block", "_ema_k", *(f"_{e}_{n}" for n in own for e in ("in", "to"))}))
    return out.select(*df.columns, *spans)


#: The part of a history that a row of a chunk is worked out in.
CHUNK = "_chunk"
#: Rows of a history in a chunk, about.
CHUNK_ROWS = 100_000


def chunked(df: DataFrame, apply: Callable[[DataFrame, Sequence[str]], DataFrame], back: int, by: Sequence[str] = ("asset",), ts: str = "ts", rows: int | None = None, every: str = "1 day", ahead: int = 0) -> DataFrame:
    """apply(df, keys) with keys that also part each history in chunks, each with `back` rows before it and `ahead` after it.

    For features that look at most so far: a long history is many tasks then. Rows are counted by time bucket; buckets
    go to chunks by the rows before them, and as a whole to the other chunks that may look at one of their rows. The
    data are shuffled once, by key and chunk.
    """
    rows = max(CHUNK_ROWS if rows is None else rows, back, ahead, 1)
    keys = [f"_k{i}" for i in range(len(by))]
    held = df.withColumn("_bucket", bucket_of(df, ts, every))
    counts = held.groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col("_bucket").alias("_kb")).agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*keys).orderBy("_kb")
    counts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.withColumn("_home", F.floor(F.col("_start") / rows))
    least = F.col("_home")
    if ahead:  # chunks that end less than `ahead` rows before this bucket
        counts = counts.withColumn("_prev", F.coalesce(F.lag("_home").over(w), F.lit(0)))
        least = F.least(F.min("_prev").over(W.partitionBy(*keys).orderBy("_start").rangeBetween(-(ahead - 1), 0)), "_home")
    last = F.floor((F.col("_start") + F.col("_n") + back - 1) / rows)
    counts = counts.select(*keys, "_kb", "_home", F.sequence(least, F.greatest(last, "_home")).alias("_into"))
    same = F.col("_bucket") == F.col("_kb")
    for c, k in zip(by, keys, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    spread = held.join(counts, same).withColumn(CHUNK, F.explode("_into")).drop("_bucket", "_kb", "_into", *keys)
    return apply(spread, [*by, CHUNK]).where(F.col(CHUNK) == F.col("_home")).drop("_home", CHUNK)


def bounded(back: Callable[[dict], int] | None = None, ahead: Callable[[dict], int] | None = None):
    """An operator that works in chunks by default: back and ahead give, of its arguments, the rows that it looks at.

    Called with keys that hold a chunk already, it works within those: operators on each other can share one chunked().
    """

    def wrap(f):
        kinds = inspect.signature(f)

        @functools.wraps(f)
        def run(df: DataFrame, *args, **named) -> DataFrame:
            given = kinds.bind(df, *args, **named)
            given.apply_defaults()
            rest = {k: v for k, v in given.arguments.items() if k not in (next(iter(kinds.parameters)), "by")}
            by = given.arguments["by"]
            if CHUNK in by:
                return f(df, **rest, by=by)
            of = lambda g: g(rest) if g else 0
            return chunked(df, lambda d, keys: f(d, **rest, by=keys), of(back), by, ahead=of(ahead))

        return run

    return wrap


def with_lookback(df: DataFrame, apply: Callable[[DataFrame], DataFrame], start, end, before: str, ts: str = "ts") -> DataFrame:
    """apply over start - before .. end, trimmed to start .. end: the scan is pruned, and frames at the start are whole."""
    lo, hi = F.lit(start).cast(df.schema[ts].dataType), F.lit(end).cast(df.schema[ts].dataType)
    return apply(df.where((F.col(ts) >= lo - F.expr(f"INTERVAL {before}")) & (F.col(ts) <= hi))).where((F.col(ts) >= lo) & (F.col(ts) <= hi))

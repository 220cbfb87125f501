"""What the named queries share: registration, the bars they run on, rounding, pieces of SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.storage import scratch as scratch
from barloom.sources.bars import event_bars


class Book:
    """Queries and their SQL by name."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__.rstrip("_")] = f
            if sql:
                self.oracles[f.__name__.rstrip("_")] = sql
            return f

        return add

    def on_bars(self, names: str, sql: str, key: str = "asset, ts", digits: int = 6):
        """A query bars -> DataFrame; names: rounded columns that it returns beside the key; sql: with the same columns."""

        def add(f):
            name = f.__name__.rstrip("_")
            self.queries[name] = lambda spark, sf_dir: pick(f(event_bars(spark, sf_dir)), names, key, digits)
            self.oracles[name] = sql
            return f

        return add


def pick(df: DataFrame, names: str, key: str = "asset, ts", digits: int = 6) -> DataFrame:
    """The key and the named columns, doubles rounded."""
    kinds = dict(df.dtypes)
    held = lambda c: (F.round(c, digits) if kinds[c] in ("double", "float") else F.col(c)).alias(c)
    return df.select(*key.split(", "), *map(held, names.split()))


#: Hourly bars of the events, as event_bars() makes them.
BARS = """bars AS (
  SELECT event_type AS asset, date_trunc('hour', events.ts) AS ts, first(value ORDER BY events.ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY events.ts, event_id) AS close, count(*)::DOUBLE AS volume
  FROM events GROUP BY 1, 2
)"""
KEY = "PARTITION BY asset ORDER BY ts"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({KEY})"


def lead(x: str, n: int = 1) -> str:
    return f"lead({x}, {n}) OVER ({KEY})"


def roll(f: str, x: str, n: int, least: int | None = None, end: int = 0) -> str:
    """f({x}) of the last n rows, null unless the window is full."""
    rows = f"ROWS BETWEEN {n - 1 - end} PRECEDING AND " + ("CURRENT ROW" if not end else f"{-end} PRECEDING")
    least = n if least is None else least
    call = f if "{x}" in f else f + "({x})"
    return f"CASE WHEN count({x}) OVER ({KEY} {rows}) >= {least} THEN {call.format(x=x)} OVER ({KEY} {rows}) END"


def listed(x: str, n: int) -> str:
    """The last n values of x as a list."""
    return f"list({x}) OVER ({KEY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def steps(*parts: str, out: str, key: str = "asset, ts", where: str = "", digits: int = 6) -> str:
    """BARS, then CTEs s1, s2, ... that each add columns to the one before; out: 'expression AS name; ...', rounded unless it begins with '='."""
    ctes, last = [BARS], "bars"
    for k, part in enumerate(parts, 1):
        ctes.append(f"s{k} AS (SELECT *, {part} FROM {last})")
        last = f"s{k}"
    shown = []
    for x in out.split(";"):
        x = x.strip()
        if x.startswith("="):
            shown.append(x[1:])
        else:
            e, _, n = x.rpartition(" AS ")
            shown.append(f"round({e}, {digits}) AS {n}" if n != x else f"round({x}, {digits}) AS {x}")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {key}, {', '.join(shown)} FROM {last}" + (f" WHERE {where}" if where else "")

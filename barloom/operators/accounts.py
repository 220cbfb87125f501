"""Accounts that only place orders their cash pays for, as a state machine over chunks of a history.

What an account may buy depends on the cash that all orders before have left, so rows wait for rows. A chunk is therefore
summed up as what it does to any account that enters it: without the guard, from being flat or from holding, it adds a
fixed amount of cash, and the guard doesn't matter if the cash that enters exceeds the worst shortfall on the way; nor
does a chunk matter to a flat account that can't pay for its least order. Histories pass through these summaries, a row
per chunk; only where neither holds is a chunk walked with the cash it is entered with, one chunk of each key at a time.
In the end every chunk knows how it is entered and all are walked side by side. No task holds a history.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import astuple, dataclass, fields
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from barloom.functions.storage import written
from barloom.functions.windows import bucket_of
from barloom.shipping import ship

#: Cash by which an order must be covered for sums to decide it; closer than that, the chunk is walked.
NEAR = 1e-6


@dataclass
class Account:
    """cash, and units bought for paid (0 if flat); orders placed, passed up by a size of 0, refused for want of cash."""

    cash: float
    units: float = 0.0
    paid: float = 0.0
    n_trades: int = 0
    skipped: int = 0
    refused: int = 0


STATE = [f.name for f in fields(Account)]
#: Columns that guarded() adds.
NEW = {"position": "integer", "cash": "double", "equity": "double", "n_trades": "long", "skipped": "long", "refused": "long"}
KINDS = {**dict.fromkeys(STATE[:3], "DOUBLE"), **dict.fromkeys(STATE[3:], "BIGINT")}


def _arrays(f: pd.DataFrame, ts: str) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    f = f.sort_values(ts)
    return f, f["_low"].to_numpy(bool), f["_high"].to_numpy(bool), f["_amount"].to_numpy(float), f["close"].to_numpy(float)


def _walk(low, high, amount, close, a: Account, guard: bool = True, begin: int = 0) -> tuple[list[tuple[int, tuple]], float]:
    """Changes a; returns (row, account) wherever it changes, and the least cash left over by an order."""
    seen, slack = [], np.inf
    for k in np.flatnonzero(low | high):
        if k < begin:
            continue
        if low[k] and not a.units:
            pay, price = float(amount[k]), float(close[k])
            if not pay > 0:
                a.skipped += 1
            elif guard and a.cash < pay or not price > 0:
                a.refused += 1
            else:
                slack = min(slack, a.cash - pay)
                a.cash, a.units, a.paid, a.n_trades = a.cash - pay, pay / price, pay, a.n_trades + 1
        elif high[k] and a.units:
            a.cash, a.units, a.paid = a.cash + a.units * float(close[k]), 0.0, 0.0
        else:
            continue
        seen.append((int(k), astuple(a)))
    return seen, slack


def _number(df: DataFrame, ts: str, every: str) -> Column:
    """The chunk of a row, in order of time."""
    bucket = bucket_of(df, ts, every)
    return bucket.cast("long") if isinstance(df.schema[ts].dataType, NumericType) else F.unix_micros(bucket.cast("timestamp"))


def guarded(df: DataFrame, x: str = "rsi_14", buy: float = 30, sell: float = 50, stake: float = 1_000.0, start: float = 10_000.0, size: str | None = None, by: Sequence[str] = ("asset",), ts: str = "ts", every: str = "30 days") -> DataFrame:
    """position, cash, equity, n_trades, skipped, refused of an account that buys for `stake` where x < buy, it is flat and
    has the cash, and sells all where x > sell.

    size: a column by which the stake of an order is multiplied; with 0 (or null) there is none, and skipped counts the rows
    where a flat account passed one up. refused counts rows where it had less than an order costs (or the price was 0).
    every: the time a chunk of a history spans.
    """
    spark = df.sparkSession
    ship(spark)
    keys = [*by, "_chunk"]
    scale = F.coalesce(F.col(size).cast("double"), F.lit(0.0)) if size else F.lit(1.0)
    flags = {"_low": F.coalesce(F.col(x) < buy, F.lit(False)), "_high": F.coalesce(F.col(x) > sell, F.lit(False)), "_amount": stake * scale, "_chunk": _number(df, ts, every)}
    held = df.drop(*NEW).withColumns(flags)
    df = df.drop(*NEW)
    kinds = ", ".join(f"{c} {held.schema[c].dataType.simpleString()}" for c in keys)
    slim = held.select(*keys, ts, "_low", "_high", "_amount", F.col("close").cast("double").alias("close"))
    one = ", ".join(f"{p}_{c} {k}" for p in "fs" for c, k in KINDS.items())

    def summary(f: pd.DataFrame) -> pd.DataFrame:
        f, low, high, amount, close = _arrays(f, ts)
        ends = np.flatnonzero(high)
        out = f[keys].head(1).assign(least=np.min(amount[low & (amount > 0)], initial=np.inf), zeros=int((low & ~(amount > 0)).sum()), orders=int((low & (amount > 0)).sum()), exit=close[ends[0]] if len(ends) else None)
        for p, begin in (("f", 0), ("s", ends[0] + 1 if len(ends) else len(f))):
            a = Account(0.0)
            _, slack = _walk(low, high, amount, close, a, guard=False, begin=begin)
            out = out.assign(**{f"{p}_{c}": [v] for c, v in zip(STATE, astuple(a))}, **{f"{p}_slack": slack})
        return out

    slim = written(slim)
    summaries = written(slim.groupBy(*keys).applyInPandas(summary, f"{kinds}, least DOUBLE, zeros BIGINT, orders BIGINT, exit DOUBLE, {one}, f_slack DOUBLE, s_slack DOUBLE"))
    entered = ", ".join(f"{c} {k}" for c, k in KINDS.items())

    def through(f: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """How each chunk is entered, up to the first that has to be walked for it (open)."""
        ends = {r["_chunk"]: Account(*(r[c] for c in STATE)) for r in known.to_dict("records")}
        a, out = Account(start), []
        for r in f.sort_values("_chunk").to_dict("records"):
            chunk, cash = r["_chunk"], a.cash
            row, p = [*(r[k] for k in keys), *astuple(a)], "f"
            if chunk in ends:
                a = ends[chunk]
            elif a.units and pd.isna(r["exit"]):
                pass
            else:
                if a.units:
                    cash, p = cash + a.units * r["exit"], "s"
                if cash + r[f"{p}_slack"] > NEAR:
                    add = Account(*(r[f"{p}_{c}"] for c in STATE))
                    a = Account(cash + add.cash, add.units, add.paid, a.n_trades + add.n_trades, a.skipped + add.skipped, a.refused + add.refused)
                elif p == "f" and cash < r["least"]:
                    a = Account(cash, 0.0, 0.0, a.n_trades, a.skipped + r["zeros"], a.refused + r["orders"])
                else:
                    out.append([*row, True])
                    break
            out.append([*row, False])
        return pd.DataFrame(out, columns=[*keys, *STATE, "open"])

    def end(f: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if not len(entry) or not len(f):
            return pd.DataFrame(columns=[*keys, *STATE])
        f, low, high, amount, close = _arrays(f, ts)
        a = Account(*(entry[c].iloc[0] for c in STATE))
        _walk(low, high, amount, close, a)
        return f[keys].head(1).assign(**dict(zip(STATE, astuple(a), strict=True)))

    same = lambda a, b: reduce(and_, (a[k].eqNullSafe(b[k]) for k in keys))
    known = spark.createDataFrame([], f"{kinds}, {entered}")
    while True:
        entries = written(summaries.groupBy(*by).cogroup(known.groupBy(*by)).applyInPandas(through, f"{kinds}, {entered}, open BOOLEAN"))
        todo = entries.where("open")
        if todo.isEmpty():
            break
        walked = slim.join(todo, same(slim, todo), "left_semi").groupBy(*keys).cogroup(todo.groupBy(*keys)).applyInPandas(end, f"{kinds}, {entered}")
        known = known.unionByName(written(walked))

    columns = df.columns

    def each(rows: pa.Table, entry: pa.Table) -> pa.Table:
        rows = rows.sort_by(ts)
        low, high, amount, close = (np.asarray(rows[c].to_numpy(), kind) for c, kind in (("_low", bool), ("_high", bool), ("_amount", float), ("close", float)))
        a = Account(*(entry[c][0].as_py() for c in STATE))
        seen = [(-1, astuple(a)), *_walk(low, high, amount, close, a)[0]]
        which = np.searchsorted([k for k, _ in seen], np.arange(len(rows)), "right") - 1
        now = {c: np.array([s[i] for _, s in seen])[which] for i, c in enumerate(STATE)}
        now |= {"position": (now["units"] != 0).astype(np.int32), "equity": now["cash"] + np.where(now["units"] != 0, now["units"] * close, 0.0)}
        return pa.table([*(rows[c] for c in columns), *(pa.array(now[c]) for c in NEW)], names=[*columns, *NEW])

    kinds_out = StructType([*df.schema.fields])
    for c, k in NEW.items():
        kinds_out = kinds_out.add(c, k)
    return held.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInArrow(each, kinds_out)

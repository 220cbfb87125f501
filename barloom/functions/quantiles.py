"""Exact quantiles of keys of any size: sketches that merge, then counts within the brackets that they give."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A sketch may be off by 1 / SHARP of a key's values, so a bracket holds about 4 / SHARP of them.
SHARP = 10_000


def exact(df: DataFrame, columns: Sequence[str], shares: Sequence[float], by: Sequence[str] = ("asset",)) -> DataFrame:
    """by, metric (a column's name), n, values: the metric's quantiles at these shares, in order, between neighbours by weight.

    Tasks send sketches of a key, not its values. What a sketch says of a rank is off by a known share, so a value lies
    between two of its answers for sure. A second pass counts values by cell: one cell for all between two brackets, and
    one for each distinct value within a bracket. The ranks asked for are then picked from the running counts. Nulls and
    NaN don't count; a key without values has n = 0 and nulls.
    """
    shares = sorted(float(p) for p in shares)
    if not shares or not 0 <= shares[0] <= shares[-1] <= 1:
        raise ValueError("shares must lie between 0 and 1")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns)))
    long = df.select(*by, each.alias("_e")).select(*by, "_e.metric", F.when(~F.isnan("_e.v"), F.col("_e.v")).alias("v"))
    keys = [*by, "metric"]
    own = [f"_k{j}" for j in range(len(keys))]
    named = [F.col(k).alias(o) for k, o in zip(keys, own, strict=True)]
    ends = [min(1.0, max(0.0, p + d / SHARP)) for p in shares for d in (-2, 2)]
    sketch = long.groupBy(*named).agg(F.count("v").alias("_n"), F.percentile_approx("v", ends, SHARP).alias("_q"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)))
    held = long.where("v IS NOT NULL").join(sketch, same)
    low, high = ([F.col("_q")[2 * i + d] for i in range(len(shares))] for d in (0, 1))
    past = reduce(lambda a, b: a + b, (h.__lt__(F.col("v")).cast("int") for h in high))
    inside = reduce(or_, (F.col("v").between(lo, hi) for lo, hi in zip(low, high, strict=True)))
    cells = held.groupBy(*own, "_n", past.alias("_past"), F.when(inside, F.col("v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.min("v").alias("_least"), F.max("v").alias("_most"))
    upto = W.partitionBy(*own).orderBy("_past", F.col("_v").asc_nulls_first())
    cells = cells.withColumn("_end", F.sum("_c").over(upto.rowsBetween(W.unboundedPreceding, 0))).withColumn("_begin", F.col("_end") - F.col("_c"))

    def at(rank: Column) -> Column:
        """The value of a rank (from 0), where a cell has it: any of a value's cell, the ends of another."""
        here = (F.col("_begin") <= rank) & (rank < F.col("_end"))
        value = F.when(F.col("_v").isNotNull() | (rank == F.col("_begin")), F.col("_least")).when(rank == F.col("_end") - 1, F.col("_most")).otherwise(F.raise_error(F.lit("a quantile lies outside its bracket")))
        return F.max(F.when(here, value))

    place = [F.lit(p) * (F.col("_n") - 1) for p in shares]
    picked = cells.groupBy(*own, "_n").agg(*(at(f(x)).alias(f"_{s}{i}") for i, x in enumerate(place) for s, f in (("f", F.floor), ("c", F.ceil))))
    values = F.array(*(F.when(F.ceil(x) == F.floor(x), F.col(f"_f{i}")).otherwise((F.ceil(x) - x) * F.col(f"_f{i}") + (x - F.floor(x)) * F.col(f"_c{i}")) for i, x in enumerate(place)))
    found = picked.select(*own, values.alias("values"))
    out = sketch.alias("s").join(found.alias("f"), reduce(and_, (F.col(f"s.{o}").eqNullSafe(F.col(f"f.{o}")) for o in own)), "left")
    nulls = F.array(*[F.lit(None).cast("double")] * len(shares))
    return out.select(*(F.col(f"s.{o}").alias(k) for k, o in zip(keys, own, strict=True)), F.col("_n").alias("n"), F.coalesce("values", nulls).alias("values"))

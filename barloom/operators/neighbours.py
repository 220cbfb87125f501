"""Exact nearest neighbours of many queries: blocks of rows around pivots, of which only those that may matter are compared.

Rows go to the nearest of a bounded number of pivots and, within such a cell, to rings of distances from it. By the triangle
inequality no row of a ring is nearer to a query than the query's own distance from the pivot is from the ring's. A query is
compared with its own ring first, which bounds the distance of its k-th neighbour; then only with rings that come closer
than that. Rows are shuffled once, and once more for each further part of a ring's queries; queries go to the rings they
need. In spaces where all distances are alike, as with independent directions, few rings can be left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.storage import written
from barloom.shipping import ship

#: Pivots, and rings in all, at most: both are known to every task.
PIVOTS, RINGS = 256, 65_536
#: Distances are rounded; bounds give way by so much of themselves.
SLACK = 1e-9


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between all of a and all of b, each summed up in the order of its coordinates."""
    d = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(d)


def _placed(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """id, vector, with cell (the nearest pivot) and far (the distance from it)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            if len(f):
                d = distances(np.stack(f.vector).astype(float), pivots)
                cell = d.argmin(axis=1)
                yield f.assign(cell=cell.astype("int32"), far=d[np.arange(len(f)), cell])

    return df.mapInPandas(work, "id LONG, vector ARRAY<DOUBLE>, cell INT, far DOUBLE")


class Plan:
    """Rows in rings around pivots, and how queries meet them."""

    def __init__(self, rows: DataFrame, block: int = 4096):
        ship(rows.sparkSession)
        self.spark, self.block = rows.sparkSession, block
        rows = rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
        n = rows.count()
        some = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(PIVOTS, n // block))).collect()  # PIVOTS vectors at most
        self.pivots = np.unique(np.array([r.vector for r in some], float), axis=0) if some else np.zeros((0, 0))
        self.empty = not len(self.pivots)
        if self.empty:
            return
        placed = written(_placed(rows, self.pivots))
        size = max(block, -(-2 * n // RINGS))
        # Borders of rings: about so many rows lie between two.
        counts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per pivot
        most = max(-(-r.n // size) for r in counts)
        shares = [i / most for i in range(1, most)]
        cuts = {r.cell: r.q or [] for r in placed.groupBy("cell").agg(F.percentile_approx("far", shares, 1000).alias("q")).collect()} if shares else {}
        keep = {r.cell: -(-r.n // size) for r in counts}
        # A cell of m rings takes m - 1 of the borders, evenly.
        borders = {c: sorted({q[round((i + 1) * most / keep[c]) - 1] for i in range(keep[c] - 1)}) for c, q in cuts.items()}
        table = self.spark.createDataFrame([(c, [float(x) for x in b]) for c, b in borders.items()] or [(-1, [])], "cell INT, borders ARRAY<DOUBLE>")
        ring = F.size(F.filter(F.coalesce("borders", F.array().cast("array<double>")), lambda b: b < F.col("far")))
        self.rows = placed.join(F.broadcast(table), "cell", "left").select("id", "vector", "cell", "far", ring.alias("ring"))  # at most RINGS borders
        found = self.rows.groupBy("cell", "ring").agg(F.min("far").alias("lo"), F.max("far").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("cell", "ring").collect()  # at most RINGS rows
        self.rings = pd.DataFrame([r.asDict() for r in found])

    def _homes(self, queries: DataFrame, k: int) -> DataFrame:
        """Each query with the ring that it would lie in, or the next one of its cell, and a distance within which k others lie for sure."""
        rings, pivots = self.rings, self.pivots
        cells, hi, count = (rings[c].to_numpy() for c in ("cell", "hi", "n"))

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in batches:
                home, within = np.zeros(len(f), np.int32), np.full(len(f), np.inf)
                for c in f.cell.unique():
                    own, here = rings[rings.cell == c], (f.cell == c).to_numpy()
                    gap = np.maximum(own.lo.to_numpy()[None] - f.far.to_numpy()[here, None], f.far.to_numpy()[here, None] - own.hi.to_numpy()[None])
                    home[here] = own.ring.to_numpy()[gap.argmin(axis=1)]
                for at in range(0, len(f), 256):
                    d = distances(np.stack(f.vector.iloc[at : at + 256]).astype(float), pivots)[:, cells] + hi[None]
                    for i, row in enumerate(d):
                        order = row.argsort()
                        enough = np.searchsorted(np.cumsum(count[order]), k + 1)  # the query itself may be one of them
                        if enough < len(order):
                            within[at + i] = row[order[enough]] * (1 + SLACK)
                yield f.assign(ring=home, within=within)[["id", "vector", "cell", "ring", "within"]]

        return _placed(queries, pivots).mapInPandas(work, "id LONG, vector ARRAY<DOUBLE>, cell INT, ring INT, within DOUBLE")

    def _needed(self, bounded: DataFrame) -> DataFrame:
        """Queries (id, vector, cell, ring, within) -> a row for each other ring that may have a neighbour."""
        rings, pivots = self.rings, self.pivots
        cells, lo, hi, number = (rings[c].to_numpy() for c in ("cell", "lo", "hi", "ring"))

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in batches:
                for at in range(0, len(f), 256):
                    g = f.iloc[at : at + 256]
                    d = distances(np.stack(g.vector).astype(float), pivots)[:, cells]
                    gap = np.maximum(np.maximum(lo[None] - d, d - hi[None]), 0.0)
                    near = gap * (1 - SLACK) - SLACK <= g.within.to_numpy()[:, None]
                    near &= (cells[None] != g.cell.to_numpy()[:, None]) | (number[None] != g.ring.to_numpy()[:, None])
                    who, which = np.nonzero(near)
                    if len(who):
                        yield pd.DataFrame({"id": g.id.to_numpy()[who], "vector": [*g.vector.to_numpy()[who]], "cell": cells[which], "ring": number[which]})

        return bounded.mapInPandas(work, "id LONG, vector ARRAY<DOUBLE>, cell INT, ring INT")

    def _compare(self, asked: DataFrame, k: int) -> DataFrame:
        """The k nearest rows of a ring for each query that asks for it: id, cell, ring, near (ids and distances), compared.

        Rings of many equal distances, and queries of a ring, are dealt over parts of about `block` each.
        """
        block = self.block
        queries = asked.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("_q"))
        rows = self.spark.createDataFrame(self.rings[["cell", "ring", "n"]])
        sizes = queries.join(rows, ["cell", "ring"]).select("cell", "ring", F.ceil(F.col("_q") / block).cast("int").alias("_nq"), F.ceil(F.col("n") / block).cast("int").alias("_nr"))
        part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = asked.join(sizes, ["cell", "ring"]).withColumn("_a", part("_nq")).withColumn("_b", every("_nr"))
        right = self.rows.join(sizes, ["cell", "ring"]).withColumn("_b", part("_nr")).withColumn("_a", every("_nq"))
        keys = ["cell", "ring", "_a", "_b"]

        def work(q: pa.Table, r: pa.Table) -> pa.Table:
            out: dict[str, list] = {c: [] for c in ("id", "neighbour", "distance", "compared")}
            if len(q) and len(r):
                vs, x = (np.stack(t["vector"].to_pylist()).astype(float) for t in (q, r))
                own, ids = q["id"].to_numpy(), r["id"].to_numpy()
                for lo in range(0, len(vs), max(1, 2_000_000 // len(x))):
                    hi = min(len(vs), lo + max(1, 2_000_000 // len(x)))
                    d = distances(vs[lo:hi], x)
                    d[own[lo:hi, None] == ids[None]] = np.inf
                    # Ties with the k-th stay until they are ordered by neighbour.
                    kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if len(x) > k else np.full((hi - lo, 1), np.inf)
                    for i in range(hi - lo):
                        to = np.flatnonzero((d[i] <= kth[i]) & (d[i] < np.inf))
                        to = to[np.lexsort((ids[to], d[i, to]))][:k]
                        out["id"].append(own[lo + i])
                        out["neighbour"].append(ids[to])
                        out["distance"].append(d[i, to])
                        out["compared"].append(len(x))
            return pa.table({"id": pa.array(out["id"], pa.int64()), "neighbour": pa.array(out["neighbour"], pa.list_(pa.int64())), "distance": pa.array(out["distance"], pa.list_(pa.float64())), "compared": pa.array(out["compared"], pa.int64())})

        return left.select(*keys, "id", "vector").groupBy(*keys).cogroup(right.select(*keys, "id", "vector").groupBy(*keys)).applyInArrow(work, "id LONG, neighbour ARRAY<LONG>, distance ARRAY<DOUBLE>, compared LONG")

    def search(self, queries: DataFrame, k: int = 15) -> tuple[DataFrame, DataFrame]:
        """id, neighbour, distance, rank of each query's k nearest rows; and id, compared: the rows it was compared with."""
        ids = queries.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
        if self.empty:
            none = ids.where("false").select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
            return none, ids.select("id", F.lit(0).cast("long").alias("compared"))
        homes = written(self._homes(ids, k))
        first = written(self._compare(homes.drop("within"), k))
        pairs = lambda d: d.select("id", F.explode(F.arrays_zip("neighbour", "distance")).alias("p")).select("id", "p.neighbour", "p.distance")
        # The k-th of the own ring's parts together; none if they have fewer.
        kth = first.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("distance"))).alias("d")).select("id", F.get("d", F.lit(k - 1)).alias("_kth"))
        bounded = homes.join(kth, "id", "left").withColumn("within", F.least("within", "_kth")).drop("_kth")
        rest = written(self._compare(self._needed(bounded), k))
        both = first.unionByName(rest)
        best = pairs(both).groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "neighbour"))), 1, k).alias("best"))
        found = best.select("id", F.posexplode("best").alias("_r", "p")).select("id", "p.neighbour", "p.distance", (F.col("_r") + 1).alias("rank"))
        return found, both.groupBy("id").agg(F.sum("compared").alias("compared"))


def nearest(queries: DataFrame, rows: DataFrame, k: int = 15, block: int = 4096) -> DataFrame:
    """id, neighbour, distance, rank: the k nearest of rows (id, vector) for each query (id, vector); a row is no neighbour of itself.

    Of equal distances the smaller id comes first. Ids of queries, and of rows, are unique.
    """
    return Plan(rows, block).search(queries, k)[0]


def compared(queries: DataFrame, rows: DataFrame, k: int = 15, block: int = 4096) -> DataFrame:
    """id, compared: how many rows each query is compared with."""
    return Plan(rows, block).search(queries, k)[1]

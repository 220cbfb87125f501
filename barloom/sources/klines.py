"""Candles of a paged service as a Spark source: spark.read.format("klines"), or readStream (sources/kline_stream.py).

Options: assets (comma-separated), start and end (epoch milliseconds), step (milliseconds of a bar), limit (bars of a
page), fetch ("module:function", importable on executors). The function gets asset, start, end and limit, and returns
rows (timestamp, open, high, low, close, volume). Pages are partitions, so they are read in parallel and read again
alone if their executor is lost; rows outside a page are dropped, so pages do not overlap.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from barloom.shipping import ship


@dataclass
class Page(InputPartition):
    asset: str
    start: int
    end: int


class KlineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.assets = [a.strip() for a in options["assets"].split(",") if a.strip()]
        self.start, self.end, self.step = (int(options[k]) for k in ("start", "end", "step"))
        self.limit, self.fetch = int(options.get("limit", 1000)), options["fetch"]

    def partitions(self) -> list[Page]:
        return self.between(self.start, self.end)

    def between(self, start: int, end: int) -> list[Page]:
        size = self.step * self.limit
        return [Page(a, lo, min(lo + size, end)) for a in self.assets for lo in range(start, end, size)]

    def read(self, page: Page) -> Iterator[tuple]:
        module, _, name = self.fetch.partition(":")
        seen = set()
        for row in getattr(importlib.import_module(module), name)(page.asset, page.start, page.end, self.limit):
            at = int(row[0])
            if page.start <= at < page.end and at not in seen:
                seen.add(at)
                yield (page.asset, *map(str, row[:6]))


class KlineSource(DataSource):
    clock: Callable[[], int] | None = None

    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return "asset STRING, timestamp STRING, open STRING, high STRING, low STRING, close STRING, volume STRING"

    def reader(self, schema) -> KlineReader:
        return KlineReader(self.options)

    def streamReader(self, schema):
        from barloom.sources.kline_stream import KlineStreamReader

        return KlineStreamReader(self.options, self.clock)


def register(spark: SparkSession, clock: Callable[[], int] | None = None) -> None:
    """clock: the service's, in epoch milliseconds; streams go by it. It is sent along as it is, like a UDF."""
    ship(spark)
    spark.dataSource.register(type("KlineSource", (KlineSource,), {"clock": staticmethod(clock)}) if clock else KlineSource)

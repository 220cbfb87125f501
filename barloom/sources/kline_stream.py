"""Candles of a paged service as a stream: spark.readStream.format("klines").

Options as for reading once, without end: from start on, a batch has the bars that have closed since the one before.
What has closed is told by the machine's clock, or by the one given to register(). An offset is a moment, the same for all
assets, so a batch that is run again after a failure reads the same bars.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSourceStreamReader

from barloom.sources.klines import KlineReader, Page


class KlineStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict, clock: Callable[[], int] | None = None):
        self.pages, self.clock = KlineReader({**options, "end": options["start"]}), clock

    def initialOffset(self) -> dict:
        return {"until": self.pages.start}

    def latestOffset(self) -> dict:
        """The end of the last bar that has closed."""
        now = self.clock() if self.clock else time.time() * 1000
        closed = max(0, int(now) - self.pages.start) // self.pages.step
        return {"until": self.pages.start + closed * self.pages.step}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return self.pages.between(start["until"], end["until"])

    def read(self, page: Page) -> Iterator[tuple]:
        return self.pages.read(page)

    def commit(self, end: dict) -> None:
        """Nothing is kept here: the service still has what was read."""

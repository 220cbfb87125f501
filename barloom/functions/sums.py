"""Sums of arrays over all rows: a task adds up its own, Spark adds up the tasks'."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from barloom.shipping import ship

#: Numbers of an array in one row, and parts in which tasks' arrays are added before they meet.
PIECE, PARTS = 16_384, 64


def summed(df: DataFrame, columns: Sequence[str], add: Callable[[dict[str, np.ndarray]], np.ndarray], size: int) -> np.ndarray:
    """The sum of add(columns of a batch) over all batches, arrays of `size` numbers; zeros without rows.

    Numbers come as doubles (null is NaN), arrays as rows of a matrix. A task sends one array, in pieces; a piece's sums
    are worked out in PARTS parts and then in one. `size` numbers come to the driver.
    """
    ship(df.sparkSession)
    names, piece, parts = list(columns), PIECE, PARTS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(size)
        for batch in batches:
            if len(batch):
                whole += np.asarray(add({c: _numbers(batch[c]) for c in names}), float).ravel()
        part = TaskContext.get().partitionId() % parts
        for k, lo in enumerate(range(0, size, piece)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([whole[lo : lo + piece]], pa.list_(pa.float64()))], ["k", "part", "v"])

    def total(f: pd.DataFrame) -> pd.DataFrame:
        return f.head(1).assign(v=[np.sum(np.stack(f.v), axis=0)])

    kinds = "k INT, part INT, v ARRAY<DOUBLE>"
    sums = df.select(*names).mapInArrow(work, kinds).groupBy("k", "part").applyInPandas(total, kinds).groupBy("k").applyInPandas(total, kinds)
    out = np.zeros(size)
    for r in sums.collect():
        out[r.k * piece : r.k * piece + len(r.v)] = r.v
    return out


def _numbers(column: pa.Array) -> np.ndarray:
    """A column of numbers as doubles; one of (nested) lists of equal lengths as an array of that many dimensions."""
    shape = [len(column)]
    while pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        column = column.flatten()
        shape.append(len(column) // max(1, int(np.prod(shape))))
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(shape)

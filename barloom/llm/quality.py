"""Quality classifier: n-gram indicators scaled by class log-count ratios, hinge loss by dual coordinate descent.

The class counts come from all labelled training rows and are summed in Spark; the linear model is fitted on a bounded
sample of them; every row is scored where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import Words, cut, map_in_arrow, mix, slices, texts_of

#: Buckets of each kind of n-gram: words, word pairs, runs of three bytes.
BUCKETS = 1 << 16
KINDS = 3
#: Labels up to which they are broadcast to the texts (about 40 bytes each).
SENT_LABELS = 2_000_000
#: UTF-8 bytes of text in a table of indicators.
PART_BYTES = 1 << 20


def indicators(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the hashed n-grams that occur in each text, each once, in order."""
    rows = len(at) - 1
    seen = np.zeros((rows, KINDS * BUCKETS), bool)
    low = np.uint64(BUCKETS - 1)
    words = Words(data, at)
    h = words.hashes()
    seen[words.row, (h & low).astype(int)] = True
    inner = np.flatnonzero(words.row[1:] == words.row[:-1])
    pair = mix(h[inner] * np.uint64(3) + h[inner + 1])
    seen[words.row[inner], BUCKETS + (pair & low).astype(int)] = True
    if len(data) > 2:
        own = np.repeat(np.arange(rows), np.diff(at))
        gram = data[:-2].astype(np.uint32) << 16 | data[1:-1].astype(np.uint32) << 8 | data[2:]
        gram = (gram * np.uint32(0x9E3779B1)) >> np.uint32(16)
        inner = own[2:] == own[:-2]
        seen[own[:-2][inner], 2 * BUCKETS + gram[inner].astype(int)] = True
    return np.divmod(np.flatnonzero(seen), KINDS * BUCKETS)


@dataclass
class Model:
    """score = sigmoid(slope * (weights of the indicators / their norm + bias) + shift); ratios are in the weights."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        row, feature = indicators(data, at)
        n = len(at) - 1
        norm = np.sqrt(np.bincount(row, self.ratio[feature] ** 2, n))
        margin = np.bincount(row, (self.ratio * self.weight)[feature], n) / np.where(norm > 0, norm, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -60, 60)))


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, c: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of least ||w||^2 / 2 + c * hinge loss, one dual variable after another in a seeded order."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    square = [float(v @ v) + 1 for v in values]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            step = min(max(alpha[i] - g / square[i], 0.0), c) - alpha[i]
            if step:
                alpha[i] += step
                w[rows[i]] += step * y[i] * values[i]
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3 * c:
            break
    return w, bias


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through margins, by Newton steps on smoothed targets."""
    good = (y > 0).sum()
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    x, b = np.stack([margin, np.ones_like(margin)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (t - p) - 1e-6 * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


SUMS = T.StructType([
    T.StructField("feature", T.IntegerType()), T.StructField("bad", T.LongType()), T.StructField("good", T.LongType()),
    T.StructField("features", T.BinaryType()), T.StructField("label", T.IntegerType()),
])


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", text: str = "text", doc_id: str = "doc_id", fit_rows: int = 6000, alpha: float = 1.0, c: float = 1.0, epochs: int = 12, seed: int = 11) -> Model:
    """A model of `label` (0 or 1) of the rows of docs whose doc_id is in labels and for which `usable` holds.

    Of several labels of one doc_id the largest counts; rows without a label, or with another value, are left out.
    fit_rows bounds the rows on which the linear model is fitted and calibrated (those of least hash); the class
    log-count ratios use all labelled rows. Rows of one class only, or none, give a constant score: 1 or 0 for that
    class, 0.5 for none.
    """
    known = labels.where(F.col(label).isin(0, 1) & usable & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("int").alias("_label"))
    known = cut(known.withColumn("_order", F.xxhash64(doc_id, F.lit(seed))), "labels")
    last = known.orderBy("_order", doc_id).limit(fit_rows).agg(F.max("_order")).first()[0]
    # Texts stay where they are unless there are too many labels to send to each task.
    near = F.broadcast(known) if known.count() <= SENT_LABELS else known
    joined = docs.select(doc_id, F.col(text).alias("_text")).join(near, doc_id).select("_text", "_label", (F.col("_order") <= F.lit(last)).alias("_fit"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, KINDS * BUCKETS), np.int64)
        for batch in slices(batches, "_text", PART_BYTES):
            row, feature = indicators(*texts_of(batch["_text"]))
            y = batch["_label"].to_numpy(zero_copy_only=False)
            for k in (0, 1):
                counts[k] += np.bincount(feature[y[row] == k], minlength=KINDS * BUCKETS)
            fit = np.flatnonzero(batch["_fit"].to_numpy(zero_copy_only=False))
            held = [feature[slice(*np.searchsorted(row, [i, i + 1]))].astype(np.int32).tobytes() for i in fit]
            none = pa.nulls(len(fit), pa.int64())
            yield pa.RecordBatch.from_arrays([none.cast(pa.int32()), none, none, pa.array(held, pa.binary()), pa.array(y[fit], pa.int32())], SUMS.names)
        some = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(counts[k][some]) for k in (0, 1)), pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.int32())], SUMS.names)

    sums = cut(map_in_arrow(joined, work, SUMS), "sums")
    total = sums.where("feature IS NOT NULL").groupBy("feature").agg(F.sum("bad"), F.sum("good")).toArrow()
    counts = np.full((2, KINDS * BUCKETS), alpha)
    for k in (0, 1):
        counts[k][total[0].to_numpy()] += total[1 + k].to_numpy()
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    sample = sums.where("feature IS NULL").select("features", "label").toArrow()
    order = sorted(range(len(sample)), key=[*zip(*(sample[c].to_pylist() for c in ("features", "label")), strict=True)].__getitem__)
    sample = sample.take(pa.array(order, pa.int64()))
    y = sample["label"].to_numpy()
    if len(set(y.tolist())) < 2:
        return Model(ratio, np.zeros_like(ratio), 0.0, 0.0, 0.0 if not len(y) else 60.0 if y[0] else -60.0)
    rows = [np.frombuffer(b.as_buffer(), np.int32) for b in sample["features"]]
    values = [ratio[r] / max(np.sqrt((ratio[r] ** 2).sum()), 1e-9) for r in rows]
    mine = np.random.default_rng(seed).random(len(y)) < 0.8
    if len(set(y[mine].tolist())) < 2 or len(set(y[~mine].tolist())) < 2:
        mine[:] = True
    sign, fit = np.where(y == 1, 1.0, -1.0), np.flatnonzero(mine)
    w, bias = descend([rows[i] for i in fit], [values[i] for i in fit], sign[fit], len(ratio), c, epochs, seed)
    rest = np.flatnonzero(~mine) if not mine.all() else fit
    margin = np.array([w[rows[i]] @ values[i] + bias for i in rest])
    return Model(ratio, w, bias, *calibrate(margin, sign[rest]))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the model's score (0 to 1) of each whole text; null and empty texts score as texts without n-grams.

    A column of docs with the name of the score is replaced; others stay.
    """
    docs = docs.drop(name)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, PART_BYTES):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.score(*texts_of(batch[text])))], schema.names)

    return map_in_arrow(docs, work, schema)

"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of the whole text (shares of byte classes, word and line figures) are standardized and mapped by
``cos(W x + b)`` with Gaussian ``W``, whose inner products approximate a Gaussian kernel. Each partition sums its part of
the normal equations; their sum is solved once for the ridge weights. Scores of a part of the rows that the ridge has not
seen are pooled into a monotone step function (pool adjacent violators), which turns scores into probabilities.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vialect.llm.common import arrow_batches, utf8, written

#: Most labelled rows that the model is fitted on; features; partitions that sum normal equations.
SAMPLE_ROWS, FEATURES, PARTS = 20_000, 256, 8
RIDGE, SEED, BINS = 1.0, 20240817, 2000
#: Predicted 1 from this score.
THRESHOLD = 0.3

_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",;:", b"!", b"?", b"#$%&*+~^", b"|", b"<>{}[]()=_/\\", b"'\"`-", b"@"]
_LUT = np.full(256, len(_CLASSES), np.uint8)
for _k, _c in enumerate(_CLASSES):
    _LUT[list(_c)] = _k
_LUT[0xC0:] = len(_CLASSES) + 1
_LUT[0x80:0xC0] = len(_CLASSES) + 2
WIDTH = len(_CLASSES) + 3 + 9


def statistics(column: pa.Array) -> np.ndarray:
    """A row of ``WIDTH`` numbers for each text; a null counts as empty, and an empty text has zeros."""
    data, offsets = utf8(column)
    rows, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((rows, WIDTH))
    full = size > 0
    if not full.any():
        return out
    kind, starts, n = _LUT[data], offsets[:-1][full], _LUT.max() + 1
    for k in range(n):
        out[full, k] = np.add.reduceat(kind == k, starts, dtype=np.int64)
    chars = np.maximum(1, size - out[:, n - 1])
    out[:, : n - 1] /= chars[:, None]
    out[:, n - 1] = np.log1p(size)
    for i, text in enumerate(column.to_pylist()):
        if not text:
            continue
        words, lines = text.split(), text.split("\n")
        w, distinct = max(1, len(words)), set(words)
        longest = max(map(len, distinct), default=0)
        dense = sum(map(len, words))
        out[i, n : n + 9] = (
            np.log1p(len(words)), dense / w, len(distinct) / w, sum(map(len, distinct)) / max(1, len(distinct)), np.log1p(longest),
            len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)), len(lines) / w, len(distinct) / np.sqrt(w),
        )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    ridge: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.cos(z @ self.weights + self.phase) * np.sqrt(2 / len(self.phase)), z / 10, np.ones((len(z), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.ridge

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.value), 0, 1)


def _partials(df: DataFrame, f: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``f(x, y, calibrate)``: an array from each of at most PARTS partitions is summed here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                x = np.array(batch.column(0).to_pylist(), np.float64)
                part = f(x, np.asarray(batch.column(1), np.float64), np.asarray(batch.column(2).to_pylist(), bool))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

    return sum(pickle.loads(bytes(r[0])) for r in df.mapInArrow(run, "part binary").collect())  # noqa: S301  our own bytes


def isotonic(at: np.ndarray, ones: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators; returns the blocks' mean positions and smoothed shares of ones, both rising."""
    blocks: list[list[float]] = []
    for x, y, n in zip(at, ones, rows, strict=True):
        if n <= 0:
            continue
        blocks.append([x * n, y, n])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    if not blocks:
        return np.zeros(1), np.full(1, 0.5)
    x = np.array([b[0] / b[2] for b in blocks])
    y = np.array([(b[1] + 0.05) / (b[2] + 0.1) for b in blocks])
    return x, np.maximum.accumulate(y)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, text: str = "text", key: str = "doc_id", label: str = "quality", bound: int = SAMPLE_ROWS) -> Model:
    """Fits on at most about ``bound`` labelled rows for which ``usable`` holds; ``usable`` is an expression over ``key``.

    The labels are drawn before the texts are read, so the drawn ones are at most ``bound`` and go to all executors;
    several labels of a key count as their maximum. Without any labelled row every score is 0.5.
    """
    arrow_batches(docs.sparkSession)
    marked = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & usable).groupBy(key).agg(F.max(label).cast("double").alias("_y"))
    n = marked.count()
    drawn = F.pmod(F.xxhash64(F.lit("quality"), F.col(key)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    marked = marked.filter(drawn < F.lit(min(1.0, bound / max(1, n))))
    texts = docs.select(F.col(key), F.col(text).alias("_text")).join(F.broadcast(marked), key)
    calibrate = F.pmod(F.xxhash64(F.lit("calibrate"), F.col(key)), F.lit(4)) == 0

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(statistics(batch.column(0)))) if len(batch) else pa.array([], pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "y", "c"])

    rows = texts.select("_text", F.col("_y"), calibrate.alias("c")).mapInArrow(measure, "x array<double>, y double, c boolean")
    rows = written(rows.coalesce(PARTS * 64), "quality").coalesce(PARTS)
    rng = np.random.default_rng(SEED)
    sums = _partials(rows, lambda x, y, c: np.stack([x.sum(0), (x * x).sum(0), np.full(x.shape[1], float(len(x)))]))
    if np.isscalar(sums):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, 1)), np.zeros(1), np.zeros(WIDTH + 2), np.zeros(1), np.full(1, 0.5))
    mean = sums[0] / sums[2]
    scale = np.sqrt(np.maximum(sums[1] / sums[2] - mean**2, 0)) + 1e-6
    model = Model(mean, scale, rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(0), np.zeros(0), np.zeros(0))

    def normal(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
        a = model.design(x[~c])
        return a.T @ np.column_stack([a, y[~c]])

    eq = _partials(rows, normal)
    model.ridge = np.linalg.solve(eq[:, :-1] + RIDGE * np.eye(len(eq)), eq[:, -1])

    def histogram(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
        bins = np.clip(((model.raw(x[c]) + 1) / 3 * BINS).astype(int), 0, BINS - 1)
        return np.stack([np.bincount(bins, y[c], BINS), np.bincount(bins, minlength=BINS)])

    ones, count = _partials(rows, histogram)
    model.at, model.value = isotonic((np.arange(BINS) + 0.5) / BINS * 3 - 1, ones, count)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted; columns of these names are replaced. Null texts count as empty ones."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    docs, at = docs.select(*[F.col(f"`{c}`") for c in kept]), kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(statistics(batch.column(at))) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(run, ", ".join([*fields, "score double", "predicted int"]))


def held_out(key: Column) -> Column:
    """Whether crc32(key as text) is divisible by 5; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))

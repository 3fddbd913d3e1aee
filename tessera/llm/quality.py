"""Quality scores by random Fourier features of document statistics.

A text becomes 22 statistics of its bytes, words and lines, standardised over the training rows. 256 random cosine features
approximate a Gaussian kernel over them; each partition sums its part of the normal equations, and the ridge solution of
their total is calibrated by isotonic regression on training rows that the ridge didn't see.

Rows whose crc32(doc_id as text) mod 5 is 0 are held out and never learned from; rows with remainder 1 calibrate, the others
fit. At most SAMPLE labels are used, chosen by a hash of doc_id. Labels, language, source and id are no inputs.

A null text counts as empty, and is scored like any other. Null labels are ignored; several labels for one doc_id count
each, of several texts the last in order. Without labels of both kinds all scores are the share of label 1, or 0.5 without any. Rows keep their doc_id, null
(not held out) or repeated, one for one; further columns are left behind. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample, cut, one_text_each, python_pass, slices, texts_of

SAMPLE = 50_000
COSINES = 256
RIDGE = 1e-3
#: Partitions of the training rows, and so of the sums that come to the driver.
PARTS = 12
PREDICT = 0.3

#: Classes of bytes: upper, lower, digit, blank, line end, full stops and commas, marks, other symbols, beyond ASCII.
_CLASS = np.full(256, 7)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 8
_CLASS[[32, 9]], _CLASS[[10, 13]], _CLASS[[44, 46]], _CLASS[[33, 63]] = 3, 4, 5, 6
STATS = 22


def statistics(text: str) -> list[float]:
    data = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(_CLASS, np.bincount(data, minlength=256), 9)
    n = max(1, len(data))
    words, lines = text.split(), text.split("\n")
    k = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    ends = sum(1 for w in words if not w[-1].isalnum())
    odd = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:!?")
    return [
        np.log1p(len(data)), np.log1p(len(words)), np.log1p(len(lines)), *np.sqrt(counts / n),
        lengths.mean(), lengths.std(), float(lengths.max()) ** 0.5, len(set(words)) / k, len({w.lower() for w in words}) / k,
        len(set(lines)) / len(lines), sum(map(str.isupper, words)) / k, ends / k, odd / k, len({*zip(words, words[1:], strict=False)}) / k,
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        stats = [[float(x) for x in statistics(t)] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "stats"])


@dataclass
class Model:
    base: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        draw = np.random.default_rng(7)
        spread = draw.normal(0, 1 / np.sqrt(stats.shape[1]), (stats.shape[1], COSINES))
        shift = draw.uniform(0, 2 * np.pi, COSINES)
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.sqrt(2 / COSINES) * np.cos(x @ spread + shift), np.ones(len(x))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.base)
        return np.clip(np.interp(self.raw(stats), *self.steps), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares nondecreasing values of y by x, as the ends of their levels; equal x share one value."""
    order = np.argsort(x, kind="stable")
    xs, first = np.unique(x[order], return_index=True)
    sums, sizes = np.add.reduceat(y[order], first), np.diff(np.append(first, len(y)))
    levels: list[list[float]] = []  # sum, size, lowest x, highest x
    for s, n, v in zip(sums, sizes, xs, strict=True):
        levels.append([s, n, v, v])
        while len(levels) > 1 and levels[-2][0] * levels[-1][1] >= levels[-1][0] * levels[-2][1]:
            s2, n2, _, hi = levels.pop()
            levels[-1][0] += s2
            levels[-1][1] += n2
            levels[-1][3] = hi
    ends = np.array([v for lv in levels for v in lv[2:]])
    return ends, np.repeat([lv[0] / lv[1] for lv in levels], 2)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """stats, y and part (the remainder, 1 to 4) of at most ``sample`` labelled rows."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("quality") > 0, 1.0).otherwise(0.0).alias("y"), remainder(F.col("doc_id")).cast("int").alias("part")
    )
    chosen = bounded_sample(known.filter("part != 0"), sample, "y")
    return cut(python_pass(one_text_each(docs, chosen), _features, "doc_id long, stats array<double>").join(chosen, "doc_id").select("stats", "y", "part").repartition(PARTS))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(-1, STATS)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = training_rows(docs, labels, sample)
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not n or ones in (0, n):
        return Model(float(ones / n) if n else 0.5)
    fitted = rows.filter("part != 1")
    moments = fitted.agg(*[F.avg(F.col("stats")[i]) for i in range(STATS)], *[F.stddev_pop(F.col("stats")[i]) for i in range(STATS)]).first()
    if any(m is None for m in moments):
        return Model(float(ones / n))
    model = Model(float(ones / n), np.array(moments[:STATS]), np.maximum(np.array(moments[STATS:]), 1e-6))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((COSINES + 1, COSINES + 2))
        for batch in slices(batches, 4096):
            z = model.cosines(_matrix(batch.column(0)))
            total += z.T @ np.column_stack([z, np.asarray(batch.column(1))])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    parts = python_pass(fitted.select("stats", "y"), sums, "total binary").collect()
    total = sum(np.frombuffer(bytes(r.total), float).reshape(COSINES + 1, COSINES + 2) for r in parts)
    ridge = RIDGE * total[-1, COSINES] * np.eye(COSINES + 1)
    ridge[-1, -1] = 0
    model.weights = np.linalg.solve(total[:, :-1] + ridge + 1e-9 * np.eye(COSINES + 1), total[:, -1])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch.column(0)))), batch.column(1)], ["x", "y"])

    held = python_pass(rows.filter("part = 1").select("stats", "y"), raw, "x double, y double").collect()
    if not held or len({r.y for r in held}) < 2:
        held = python_pass(fitted.select("stats", "y"), raw, "x double, y double").collect()
    model.steps = isotonic(np.array([r.x for r in held]), np.array([r.y for r in held]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; one narrow pass without shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            stats = np.array([statistics(t) for t in batch.column(1).to_pylist()], float).reshape(-1, STATS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(stats), pa.float64())], ["doc_id", "score"])

    scored = python_pass(texts_of(docs), run, "doc_id long, score double")
    held = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= PREDICT, 1).otherwise(0).alias("predicted"))

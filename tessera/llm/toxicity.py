"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are a text's distinct words and their prefixes of three to eight letters, lower-cased: prefixes carry over to
inflected forms that the labels lack. Grades are 0 for rows labelled clean, and 1 or 2 for rows labelled toxic with fewer
or more distinct features that go with the label than their median. One weight vector serves both ordered thresholds:
P(grade >= k) = sigmoid(w x - t_k), t_1 < t_2; the expected severity is the sum of both.

The model is fitted on at most SAMPLE labelled documents, chosen by a hash of doc_id; all documents are scored in one narrow pass.
Features must occur in MIN_DOCS toxic rows and be associated with the label by Z standard errors; all that are so go into the model.
Labels have two values only, so the second grade is a matter of how much speaks for the label, not of a severity that someone judged.

A null text counts as empty; texts without known features have the severity of the thresholds alone, near 0. Labels that
are null are ignored; of several labels for one doc_id the highest counts, of several texts the last in order. Without labels of both kinds, every severity is
0 and nothing is rejected. Rows keep their doc_id, null or repeated, one for one. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample, cut, one_text_each, python_pass, slices, texts_of

#: Labelled documents that the fit uses at most, and so a bound of all that it gathers.
SAMPLE = 20_000
MIN_DOCS, Z = 4, 5.0
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Probability of grade 1 or higher from which a document is rejected.
REJECT = 0.5
CACHED = 100_000

_WORDS = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    return set(_WORDS.findall(text.lower()))


def features(word: str) -> list[str]:
    """The word itself, marked as whole, and its prefixes."""
    return [f"{word}$", *[word[:n] for n in PREFIXES if len(word) >= n]]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()

    def __post_init__(self):
        self._cache: dict[str, tuple[str, ...]] = {}

    def present(self, text: str) -> set[str]:
        """The model's features in a text."""
        cache, weights = self._cache, self.weights
        if len(cache) > CACHED:
            cache.clear()
        found: set[str] = set()
        for w in words(text):
            if (f := cache.get(w)) is None:
                cache[w] = f = tuple(x for x in features(w) if x in weights)
            if f:
                found.update(f)
        return found

    def tail(self, text: str) -> list[float]:
        """P(grade >= k) for each k from 1 on."""
        score = sum(sorted(self.weights[f] for f in self.present(text)))
        return [float(1 / (1 + np.exp(-np.clip(score - t, -500, 500)))) for t in self.thresholds]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic and clean rows of each feature, in parts that another step adds up."""

    def part() -> pa.RecordBatch:
        names = list(seen[0].keys() | seen[1].keys())
        columns = [pa.array([seen[k][f] for f in names], pa.int64()) for k in (1, 0)]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *columns], ["f", "toxic", "clean"])

    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in slices(batches, 64):
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen[toxic].update({f for w in words(text) for f in features(w)})
        if len(seen[0]) + len(seen[1]) > CACHED:
            yield part()
            seen = (Counter(), Counter())
    yield part()


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and toxic (0, 1) of at most ``sample`` labelled rows."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    chosen = bounded_sample(known, sample)
    return cut(one_text_each(docs, chosen).join(chosen, "doc_id").select("text", "toxic"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = training_rows(docs, labels, sample)
    totals = {r.toxic: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return Model()
    counts = python_pass(rows, _count, "f string, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    n1, n0 = totals[1], totals[0]
    p, q, both = F.col("a") / n1, F.col("b") / n0, (F.col("a") + F.col("b")) / (n1 + n0)
    z = (p - q) / F.sqrt(both * (1 - both) * (1 / n1 + 1 / n0))
    names = sorted(r.f for r in counts.filter(F.col("a") >= MIN_DOCS).filter(z >= Z).select("f").collect())
    probe = Model(dict.fromkeys(names, 0.0))
    place = {f: i for i, f in enumerate(names)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = [sorted(place[f] for f in probe.present(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), batch.column(1)], ["ids", "toxic"])

    # rows without a known feature differ in their label only
    sparse = python_pass(rows, present, "ids array<int>, toxic int").groupBy("ids", "toxic").agg(F.count("*").alias("n")).collect()
    sparse.sort(key=lambda r: (r.ids, r.toxic))
    return _fit(names, [r.ids for r in sparse], np.array([r.toxic for r in sparse]), np.array([r.n for r in sparse], float))


class Problem:
    """Weighted likelihood of grades under one weight vector, a first threshold and the log of the gap to the second."""

    def __init__(self, size: int, rows: list[list[int]], toxic: np.ndarray, times: np.ndarray, ridge: float):
        self.size, self.n, self.ridge, self.share = size, len(rows), ridge, times / times.sum()
        sizes = np.array([len(r) for r in rows])
        self.grade = np.where(toxic == 1, np.where(sizes >= np.median(np.repeat(sizes[toxic == 1], times[toxic == 1].astype(int))), 2, 1), 0)
        self.row = np.repeat(np.arange(self.n), sizes)
        self.col = np.concatenate([np.array(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)

    def start(self) -> np.ndarray:
        return np.concatenate([np.zeros(self.size), [1.0, 1.0]])

    def loss(self, state: np.ndarray) -> tuple[float, np.ndarray]:
        """What is to be made small, and its gradient."""
        sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
        score = np.bincount(self.row, state[self.col], self.n)
        t1, gap = state[-2], np.exp(state[-1])
        a, b = sigmoid(score - t1), sigmoid(score - t1 - gap)  # P(>= 1), P(>= 2)
        likely = np.choose(self.grade, [1 - a, a - b, b]) + 1e-12
        da = np.choose(self.grade, [-1 / likely, 1 / likely, 0 * likely]) * a * (1 - a)
        db = np.choose(self.grade, [0 * likely, -1 / likely, 1 / likely]) * b * (1 - b)
        slope = -self.share * (da + db)
        value = -(self.share * np.log(likely)).sum() + self.ridge / 2 * (state[:-2] ** 2).sum()
        weights = np.bincount(self.col, slope[self.row], self.size) + self.ridge * state[:-2]
        return float(value), np.concatenate([weights, [(self.share * (da + db)).sum(), (self.share * db).sum() * gap]])


def _fit(names: list[str], rows: list[list[int]], toxic: np.ndarray, times: np.ndarray, steps: int = 600, ridge: float = 3e-5) -> Model:
    """Maximum likelihood by Adam steps over all rows."""
    problem = Problem(len(names), rows, toxic, times, ridge)
    state = problem.start()
    first, second = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, steps + 1):
        _, grad = problem.loss(state)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        state = state - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(dict(zip(names, state[:-2].tolist(), strict=True)), (float(state[-2]), float(state[-2] + np.exp(state[-1]))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_severity, grade (the likeliest), p_toxic and kept for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tails = [model.tail(t) for t in batch.column(1).to_pylist()]
            p = [t[0] if t else 0.0 for t in tails]
            grade = [int(np.argmax(-np.diff([1.0, *t, 0.0]))) if t else 0 for t in tails]
            columns = [pa.array([sum(t) for t in tails], pa.float64()), pa.array(grade, pa.int32()), pa.array(p, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "expected_severity", "grade", "p_toxic"])

    scored = python_pass(texts_of(docs), run, "doc_id long, expected_severity double, grade int, p_toxic double")
    return scored.withColumn("kept", F.col("p_toxic") < REJECT)


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that are rejected, decided where they lie: nothing is shuffled."""
    model = fit(docs, labels, sample)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            clean = [not (t := model.tail(x or "")) or t[0] < REJECT for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return python_pass(docs, run, docs.schema)

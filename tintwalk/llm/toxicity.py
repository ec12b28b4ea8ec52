"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(s - t_k): one score s of a text serves all thresholds t_0 <= t_1 <= ..., and the expected severity is the
sum of these probabilities. Features are the words that occur in a text, and for the beginnings of words of 4, 5 and 6 letters whether they
occur once, twice, three times or more; all are hashed. A feature counts if it stands in toxic texts so much oftener than in others that
chance hardly explains it, and has its log odds for a value; s is the weighted mean of a text's values, drawn towards 0 where
there are few. Weights are never negative: clean words don't make up for toxic ones, however long the text. They are fitted in
numpy on the likelihood of the grades.

Training takes a bounded sample, up to ``PER_GRADE`` labelled rows and ``ENTRIES`` features of each grade, drawn by a hash of the id and
weighted back to their true share; a fifth of it is kept back to choose the probability from which a text counts as toxic.

Defined cases: null and empty texts have no features, their severity is that of the thresholds alone; texts are read whole; repeated
rows get equal results; labels that repeat for an id count at their highest; without labelled rows severity is 0 everywhere; where there are toxic rows only, or none, every
text has the shares of the grades, so that one grade alone is everyone's.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tintwalk.llm.common import lists, table

BUCKETS, PER_GRADE, ENTRIES = 1 << 18, 4000, 4_000_000
BEGINNINGS, LEVELS = (4, 5, 6), 4
#: Standard errors of the log odds from which a feature counts; values that stand for nothing in the mean; penalty of squared weights.
CERTAIN, DRAWN, PENALTY = 2.5, 10.0, 1.0
STEPS, RATE, SEED = 300, 0.1, 9
WORDS = re.compile(r"[^\W\d_]+")
#: Code points read at a time, which bounds memory on very long texts.
CHUNK = 1 << 20


@lru_cache(maxsize=1 << 17)
def whole(word: str) -> int:
    return zlib.crc32(f"={word}".encode()) % BUCKETS


@lru_cache(maxsize=1 << 17)
def beginnings(word: str) -> tuple[int, ...]:
    return tuple(zlib.crc32(word[:n].encode()) for n in BEGINNINGS if len(word) >= n)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of ``text``."""
    text, words = text or "", set()
    starts, times = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = 0
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and text[end].isalpha() and end < at + 2 * CHUNK:  # not within a word
            end += 1
        found = WORDS.findall(text[at:end].lower())
        words.update(map(whole, found))
        more, n = np.unique(np.fromiter(chain.from_iterable(map(beginnings, found)), dtype=np.int64), return_counts=True)
        starts, place = np.unique(np.concatenate([starts, more]), return_inverse=True)
        times = np.bincount(place, np.concatenate([times, n])).astype(np.int64)
        at = end
    levels = [(starts[times >= k] * LEVELS + k) % BUCKETS for k in range(1, LEVELS + 1)]
    return np.unique(np.concatenate([np.fromiter(words, dtype=np.int64, count=len(words)), *levels]))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    values: np.ndarray  # log odds of the features that count, else 0
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5  # P(grade > 0) from which a text is toxic

    def score(self, x: np.ndarray) -> float:
        values = self.values[x]
        return float(values @ self.weights[x]) * spread(values.sum())

    def above(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return sigmoid(self.score(x) - self.thresholds)


def spread(total):
    return 2 * DRAWN / (DRAWN + total)


def sample(docs: DataFrame, grades: DataFrame, per_grade: int = PER_GRADE, entries: int = ENTRIES) -> list[tuple[int, float, np.ndarray]]:
    """(grade, weight, buckets) of up to ``per_grade`` rows of each grade; ``grades(doc_id, grade)``. Features are made on the executors.

    The first ids of each grade in the order of a hash are drawn, and of the rows of an id one; a grade's rows end where their features
    exceed ``entries``, so that what comes to the driver is bounded however long the texts are.
    """
    grades = grades.groupBy("doc_id").agg(F.max("grade").alias("grade")).where("grade is not null and doc_id is not null")
    counts = {r[0]: r[1] for r in grades.groupBy("grade").count().collect()}
    if not counts:
        return []
    chance = F.create_map(*[F.lit(x) for grade, n in counts.items() for x in (grade, min(1.0, 2 * per_grade / n))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    few = grades.withColumn("draw", draw).where(F.col("draw") < chance[F.col("grade")])
    few = few.withColumn("place", F.row_number().over(Window.partitionBy("grade").orderBy("draw", "doc_id"))).where(F.col("place") <= per_grade).drop("place")
    drawn = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # per_grade ids of each grade at most: a proven bound
    drawn = drawn.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))).where("number = 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([features(t.as_py()) for t in batch.column(3)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], found], names=["doc_id", "grade", "draw", "x"])

    rows = drawn.select("doc_id", "grade", "draw", "text").mapInArrow(run, "doc_id long, grade int, draw double, x array<int>")
    held = F.sum(F.size("x")).over(Window.partitionBy("grade").orderBy("draw", "doc_id"))
    rows = rows.withColumn("held", held).where(F.col("held") <= entries).select("doc_id", "grade", "x").toArrow().sort_by("doc_id")
    found = rows.column("grade").to_pylist()
    taken = {grade: found.count(grade) for grade in counts}
    return [(grade, counts[grade] / taken[grade], x) for grade, x in zip(found, lists(rows, "x"), strict=True)]


def likelihood(s: np.ndarray, t: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood of the grades ``y`` given scores ``s`` and thresholds ``t``, with its gradients by ``s`` and by ``t``."""
    limits = np.concatenate([[-np.inf], t, [np.inf]])
    a, b = sigmoid(s - limits[y]), sigmoid(s - limits[y + 1])
    p = np.maximum(a - b, 1e-9)
    below, above = (np.bincount(y, weight * x * (1 - x) / p, minlength=len(t) + 1) for x in (a, b))
    return float(-(weight * np.log(p)).sum()), -weight * (1 - a - b), below[1:] - above[:-1]


def train(rows: list[tuple[int, float, np.ndarray]], steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY, seed: int = SEED) -> Model:
    """Projected gradient steps on the whole sample, each coordinate at its own pace; a fifth of the rows is kept back for the cut."""
    grades, weights = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows])
    top = int(grades.max(initial=0))
    order = np.random.default_rng(seed).permutation(len(rows))
    kept, fit = order[: len(rows) // 5], order[len(rows) // 5 :]
    toxic = grades[fit] > 0
    if not toxic.any() or toxic.all():
        share = np.array([np.average(grades > k, weights=weights) if len(rows) else 0.0 for k in range(max(top, 1))])
        with np.errstate(divide="ignore"):
            return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), np.clip(np.log(1 - share) - np.log(share), -40, 40))
    seen = [np.bincount(np.concatenate([rows[i][2] for i in fit[of]]), minlength=BUCKETS) + 0.5 for of in (toxic, ~toxic)]
    many = toxic.sum() + 1, (~toxic).sum() + 1
    odds = np.log(seen[0] / many[0]) - np.log(seen[1] / many[1])
    error = np.sqrt(np.maximum(1 / seen[0] + 1 / seen[1] - 1 / many[0] - 1 / many[1], 1e-9))
    values = np.where(odds / error >= CERTAIN, odds, 0.0)

    x = [r[values[r] > 0] for r in (rows[i][2] for i in fit)]
    row, col = np.repeat(np.arange(len(fit)), [len(r) for r in x]), np.concatenate(x)
    names, col = np.unique(col, return_inverse=True)
    value = values[names][col]
    value *= spread(np.bincount(row, value, minlength=len(fit)))[row]
    y, weight = grades[fit], weights[fit] / weights[fit].mean()
    share = np.clip([np.average(y > k, weights=weight) for k in range(top)], 1e-6, 1 - 1e-6)
    t, w = -np.log(share / (1 - share)), np.full(len(names), 0.2)
    w_squares, t_squares = np.full(len(names), 1e-6), np.full(top, 1e-6)
    for _ in range(steps):
        s = np.bincount(row, value * w[col], minlength=len(fit))
        _, s_back, t_back = likelihood(s, t, y, weight)
        w_back = np.bincount(col, value * s_back[row], minlength=len(names)) + penalty * w
        w_squares += w_back**2
        t_squares += t_back**2
        w = np.maximum(w - rate * w_back / np.sqrt(w_squares), 0)
        t = np.maximum.accumulate(t - rate * t_back / np.sqrt(t_squares))
    full = np.zeros(BUCKETS)
    full[names] = w
    model = Model(values, full, t)
    if len(kept):
        p = np.array([model.above(rows[i][2])[0] for i in kept])
        w, toxic = weights[kept], grades[kept] > 0
        cuts = np.linspace(0.05, 0.95, 91)
        f1 = [2 * w[toxic & (p >= c)].sum() / max(w[toxic].sum() + w[p >= c].sum(), 1e-9) for c in cuts]
        best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)
        model.cut = float(cuts[best[len(best) // 2]])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, severity, grade, toxic`` for each row: expected severity, the likeliest side of each threshold, and P(grade > 0) >= cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = np.array([model.above(features(t.as_py())) for t in batch.column(1)]).reshape(len(batch), -1)
            columns = [pa.array(above.sum(axis=1)), pa.array((above >= 0.5).sum(axis=1), pa.int32()), pa.array(above[:, 0] >= model.cut)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "severity", "grade", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, severity double, grade int, toxic boolean")


def severity_grades(labels: DataFrame) -> DataFrame:
    """Grades from ``labels``: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).when(F.col("toxic") == 0, 0).cast("int").alias("grade"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(sample(docs, severity_grades(table(spark, sf_dir, "labels")))))

"""Quality classifier: ridge regression on random Fourier features, calibrated by isotonic regression.

Each text becomes a row of document statistics (``STATS``): character classes,
word and line shapes and repetition. They are standardised with moments over
all rows. Random Fourier features approximate a Gaussian kernel on them, every
partition sums its share of the normal equations, the driver solves one system
of ``FEATURES + 1`` unknowns, and scores are calibrated by isotonic regression
over score bins summed in Spark. All labelled training rows are used; what
reaches the driver is bounded by ``FEATURES`` and ``BINS`` alone.

Null texts count as empty; an empty text is scored by its (zero) statistics.
Equal texts get equal scores. Null labels are left out, several labels of a
document are averaged. Without labelled rows every score is the neutral 0.5.
An empty table gives an empty result; further columns of any name pass.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

FEATURES = 192
WIDTH = 3.0
RIDGE = 1.0
BINS = 2048
SEED = 11
#: Byte classes: 0 other punctuation, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 beyond ASCII, 7 sentence
#: marks, 8 bars, 9 exclamation and question marks, 10 symbols, 11 control.
CLASSES = np.zeros(256, np.uint8)
CLASSES[:32] = 11
CLASSES[list(range(97, 123))] = 1
CLASSES[list(range(65, 91))] = 2
CLASSES[list(range(48, 58))] = 3
CLASSES[[9, 32]] = 4
CLASSES[[10, 13]] = 5
CLASSES[128:] = 6
CLASSES[list(b".,;:'\"-()")] = 7
CLASSES[ord("|")] = 8
CLASSES[list(b"!?")] = 9
CLASSES[list(b"#$%&*@^~_=+<>[]{}\\/`")] = 10
N_CLASSES = 12
STATS = N_CLASSES + 14


def statistics(text: bytes | None) -> np.ndarray:
    """The statistics of one text."""
    out = np.zeros(STATS)
    if not text:
        return out
    n = len(text)
    out[:N_CLASSES] = np.sqrt(np.bincount(CLASSES[np.frombuffer(text, np.uint8)], minlength=N_CLASSES) / n)
    words = text.lower().split()
    if not words:
        return out
    k = len(words)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split(b"\n") if x]
    lengths = np.fromiter(map(len, words), np.int64, k)
    out[N_CLASSES:] = (
        np.log1p(k) / 3, np.log1p(n / max(1, len(lines))) / 3, np.log1p(len(lines)) / 3, lengths.mean() / 6, lengths.std() / 6,
        len(counts) / k, max(counts.values()) / k, (pairs + 1) / k, len(set(lines)) / max(1, len(lines)),
        (lengths <= 3).mean(), (lengths >= 12).mean(), np.log1p(lengths.max()) / 3,
        sum(a == b for a, b in zip(words, words[1:])) / k, np.log(len(counts)) / np.log(k + 1),
    )
    return out


def stats_column(text: str | Column) -> Column:
    """The statistics of a text column."""
    @arrow_udf("array<double>")
    def counted(text: pa.Array) -> pa.Array:
        return pa.array([statistics(x) for x in text.to_pylist()], pa.list_(pa.float64()))

    return counted((F.col(text) if isinstance(text, str) else text).cast("binary"))


class Model:
    """Moments, random features, ridge weights and the calibration steps; small and of fixed size."""

    def __init__(self, mean, std, weights=None, steps=None):
        rng = np.random.default_rng(SEED)
        self.mean, self.std = np.asarray(mean), np.where(np.asarray(std) > 1e-9, std, 1.0)
        self.omega = rng.normal(0, 1 / WIDTH, (STATS, FEATURES))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights, self.steps = weights, steps

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.std, -6, 6)
        z = np.sqrt(2 / FEATURES) * np.cos(x @ self.omega / np.sqrt(STATS / 4) + self.phase)
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(stats):
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), *self.steps), 0, 1)


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, STATS)


def score_column(model: Model, stats: str | Column) -> Column:
    @arrow_udf("double")
    def scored(stats: pa.Array) -> pa.Array:
        return pa.array(model.score(matrix(stats)), pa.float64())

    return scored(stats)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points sorted by x: block centres and their values."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    sums = np.array(blocks)
    return sums[:, 0] / sums[:, 2], sums[:, 1] / sums[:, 2]


def fit(stats: DataFrame, labelled: DataFrame) -> Model:
    """Fit on ``labelled`` (stats, label), standardised by the moments of ``stats`` (stats), all rows."""
    moments = stats.select(F.posexplode("stats")).groupBy("pos").agg(F.avg("col"), F.stddev_pop("col")).collect()
    mean, std = np.zeros(STATS), np.ones(STATS)
    for i, m, s in moments:
        mean[i], std[i] = m, s
    model, at = Model(mean, std), np.triu_indices(FEATURES + 1)

    def summed(batches):
        a, b = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        n = 0
        for batch in batches:
            z = model.features(matrix(batch.column("stats")))
            n += len(z)
            a += z.T @ z
            b += z.T @ np.asarray(batch.column("label"))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([a[at], b])], pa.list_(pa.float64()))], names=["cells"])

    cells = labelled.select("stats", "label").mapInArrow(summed, "cells array<double>")
    sums = cells.select(F.posexplode("cells")).groupBy("pos").agg(F.sum("col")).collect()  # a fixed number of cells
    if not sums:
        return model
    flat = np.zeros(len(at[0]) + FEATURES + 1)
    for i, v in sums:
        flat[i] = v
    a = np.zeros((FEATURES + 1, FEATURES + 1))
    a[at] = flat[: len(at[0])]
    a = a + np.triu(a, 1).T
    model.weights = np.linalg.solve(a + RIDGE * np.diag([1.0] * FEATURES + [1e-6]), flat[len(at[0]):])

    @arrow_udf("double")
    def raw(stats: pa.Array) -> pa.Array:
        return pa.array(np.round(np.clip(model.raw(matrix(stats)), -1, 2) * BINS / 3) * 3 / BINS, pa.float64())

    bins = labelled.select(raw("stats").alias("x"), "label").groupBy("x").agg(F.avg("label"), F.count("*")).orderBy("x").collect()
    x, y, w = np.array(bins, float).T
    model.steps = isotonic(x, (y * w + 0.5 * y.dot(w) / w.sum()) / (w + 0.5), w + 0.5)
    return model


def labelled_stats(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """(stats, label) of the rows of ``stats`` (doc_id, stats) that have a label."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("__d")).agg(
        F.avg(label).alias("label"))
    return stats.join(known, F.col(doc_id) == F.col("__d")).select("stats", "label")

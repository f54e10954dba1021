"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

Statistics of a text (shares of byte classes, repetition, lengths) are computed once and written, about 16 numbers a
row. ``DIM`` random cosine features approximate a Gaussian kernel on the standardised statistics. Each partition
sums its part of the normal equations, Spark adds the parts, and only the ``(DIM + 1)^2`` sums come to the driver. Labels
of folds 1 to 3 fit the ridge, those of fold 4 the isotonic map (over ``BINS`` bins of the raw score); fold 0 is
never learned from.

Defined results: null and empty texts have all-zero statistics and a score like any other; a text without a label, or
with a null one, is scored only; repeated labels count each time; without usable labels every score is 0.5, and without
labels in fold 4 the raw score is clipped to 0..1.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import bounded_batches, fold
from tidemark.session import cut_lineage

DIM = 200
RIDGE = 1e-3
SEED = 20
BINS = 2000
CLIP = 6.0
STATS = 16
PREDICT_AT = 0.3


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256, np.float64)
    m[list(chars)] = 1
    return m


CLASSES = np.array([
    _mask(bytes(range(97, 123))), _mask(bytes(range(65, 91))), _mask(bytes(range(48, 58))), _mask(b"\t\n\x0b\x0c\r "),
    _mask(bytes(range(128, 256))), _mask(b"#*$%&|<>~^{}[]\\"), _mask(b".,;:?'\""), _mask(b"!"),
])


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, each about 0 to 1."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    found = (text or "").split()
    if not found:
        return [0.0] * STATS
    n, w = len(raw), len(found)
    shares = CLASSES @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    counts = Counter(found)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        *shares.tolist(),
        np.log1p(w) / 10,
        len(counts) / w,
        max(counts.values()) / w,
        sum(map(operator.eq, found, found[1:])) / w,
        min((n - w) / w / 20, 2.0),
        1 - len(set(lines)) / len(lines),
        np.log1p(w / len(lines)) / 10,
        sum(1 for x in counts if not any(map(str.isalnum, x))) / w,
    ]


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the statistics of every text, written once."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "x": [statistics(t) for t in pdf["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = bounded_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    return cut_lineage(rows.mapInPandas(work, f"doc_id {kind}, x array<double>"))


class Model:
    """Fitted map from statistics to a score of 0 to 1."""

    def __init__(self, mean, scale, beta=None, knots=None):
        rng = np.random.RandomState(SEED)
        self.mean, self.scale, self.beta, self.knots = mean, scale, beta, knots
        self.omega = rng.standard_normal((STATS, DIM)) / np.sqrt(STATS)
        self.phase = rng.uniform(0, 2 * np.pi, DIM)

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        cos = np.cos(z @ self.omega + self.phase) * np.sqrt(2.0 / DIM)
        return np.hstack([cos, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        return np.clip(np.interp(raw, *self.knots) if self.knots else raw, 0.0, 1.0)


def _stack(xs) -> np.ndarray:
    return np.array(xs.tolist(), np.float64).reshape(len(xs), STATS)


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    size = DIM + 1

    def work(batches):
        total = np.zeros((size, size + 1))
        for pdf in batches:
            z = model.map(_stack(pdf["x"]))
            total += z.T @ np.hstack([z, pdf["y"].to_numpy(np.float64)[:, None]])
        i, j = np.nonzero(np.triu(np.ones_like(total)))
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    cells = rows.select("x", "y").mapInPandas(work, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    g = np.zeros((size, size + 1))
    g[cells["i"], cells["j"]] = cells["v"]
    square = np.triu(g[:, :size]) + np.triu(g[:, :size], 1).T
    return square, g[:, size]


def pool(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit of rates ``y / n`` at increasing ``x`` (pool adjacent violators): knots and values."""
    blocks: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n):
        blocks.append([xi * ni, yi, ni])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", (F.col("quality") == 1).cast("double").alias("y"))
    rows = cut_lineage(stats.join(known, "doc_id").withColumn("__fold", fold(F.col("doc_id"))).filter("__fold <> 0"))
    learn, check = rows.filter("__fold < 4"), rows.filter("__fold = 4")
    cells = [F.col("x")[i] for i in range(STATS)]
    r = learn.agg(F.count(F.lit(1)), *[F.avg(c) for c in cells], *[F.stddev_pop(c) for c in cells]).first()
    if not r[0]:
        return Model(np.zeros(STATS), np.ones(STATS))
    scale = np.array(r[1 + STATS :])
    model = Model(np.array(r[1 : 1 + STATS]), np.where(scale > 1e-6, scale, 1.0))
    square, right = _normal_equations(learn, model)
    model.beta = np.linalg.solve(square + RIDGE * r[0] / DIM * np.eye(DIM + 1), right)

    def work(batches):
        for pdf in batches:
            raw = np.clip(model.raw(_stack(pdf["x"])), -1.0, 2.0)
            yield pd.DataFrame({"bin": np.floor(raw * BINS).astype(np.int64), "raw": raw, "y": pdf["y"]})

    bins = check.select("x", "y").mapInPandas(work, "bin long, raw double, y double").groupBy("bin").agg(
        F.avg("raw").alias("raw"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")
    ).toPandas().sort_values("bin")
    if len(bins):
        model.knots = pool(bins["raw"].to_numpy(), bins["y"].to_numpy(), bins["n"].to_numpy(np.float64))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""

    def work(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": model.score(_stack(pdf["x"]))})

    kind = stats.schema["doc_id"].dataType.simpleString()
    rows = stats.mapInPandas(work, f"doc_id {kind}, score double")
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = features(docs)
    return score(stats, fit(stats, labels))

"""Regularised quadratic discriminant over document statistics.

Statistics of the whole text are transformed to be roughly normal. Each class has its mean and a covariance shrunk
towards the pooled variances; scores are Mahalanobis log-density differences from cached Cholesky factors, brought to
0..1 by a logistic curve fitted on rows that the covariances have not seen.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from fieldspark.llm.common import lean_worker

#: Labelled rows that the model is fitted on at most, shrinkage, and the score from which a document is predicted 1.
SAMPLE, SHRINKAGE, THRESHOLD = 20_000, 0.1, 0.3
#: Labels are learned only from rows whose crc32(doc_id) mod 5 is not 0.
FOLDS = 5
_SYMBOLS, _MARKS, _DIGITS, _UPPER = b"*#$%&@<>{}[]\\^~_=+/", b".,;:", b"0123456789", bytes(range(65, 91))
FEATURES = ("words", "word_length", "distinct", "top_word", "same_as_before", "symbols", "bars", "cries", "upper", "digits", "marks", "lines", "distinct_lines", "non_ascii")


def _log_odds(share: float, n: int) -> float:
    """Log odds of a share of ``n``, with half a count added on either side."""
    return math.log((share * n + 0.5) / ((1 - share) * n + 0.5))


def statistics(text: bytes) -> list[float]:
    """The features of a text; an empty one has finite values too."""
    words, n = text.split(), len(text)
    k = len(words)
    if not k:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]

    def share(chars: bytes) -> float:
        return math.log((n - len(text.translate(None, chars)) + 0.5) / (n + 1))

    return [
        math.log(k), math.log((n - k + 1) / k + 0.1), _log_odds(len(counts) / k, k), _log_odds(max(counts.values()) / k, k),
        math.log((sum(map(eq, words, words[1:])) + 0.5) / k), share(_SYMBOLS), math.log((text.count(b"|") + 0.5) / (n + 1)), math.log((text.count(b"!") + 0.5) / (n + 1)),
        share(_UPPER), share(_DIGITS), share(_MARKS), math.log(len(lines) / k), _log_odds(len(set(lines)) / len(lines), len(lines)),
        math.log((n - len(text.decode(errors="replace")) + 0.5) / (n + 1)),
    ]


@dataclass
class Discriminant:
    """Fitted model; ``prior`` alone is the score where only one class, or none, was seen."""

    prior: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: tuple[np.ndarray, ...] = ()
    inverse: tuple[np.ndarray, ...] = ()  #: inverses of the Cholesky factors
    half_logdet: tuple[float, ...] = ()
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        z = (x - self.centre) / self.scale
        density = [-0.5 * (((z - m) @ i.T) ** 2).sum(1) - h for m, i, h in zip(self.means, self.inverse, self.half_logdet)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.prior)
        return _curve(self.slope * np.clip(self.difference(x), -50, 50) + self.shift)


def _curve(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant:
    """Fits on three of four rows in the given order, and the curve on the fourth."""
    prior = float((y.sum() + 0.5) / (len(y) + 1))
    held = np.arange(len(y)) % 4 == 3
    if len(y) == 0 or min((y[~held] == c).sum() for c in (0, 1)) < 2:
        return Discriminant(prior)
    a, b = x[~held], y[~held]
    centre, scale = a.mean(0), a.std(0) + 1e-6
    z = (a - centre) / scale
    pooled = np.mean([z[b == c].var(0) for c in (0, 1)], axis=0) + 1e-3
    means, inverse, half = [], [], []
    for c in (0, 1):
        own = z[b == c]
        factor = np.linalg.cholesky((1 - shrinkage) * np.cov(own.T, bias=True) + shrinkage * np.diag(pooled))
        means.append(own.mean(0))
        inverse.append(np.linalg.inv(factor))
        half.append(float(np.log(np.diag(factor)).sum()))
    model = Discriminant(prior, centre, scale, tuple(means), tuple(inverse), tuple(half))
    t, want = np.clip(model.difference(x[held]), -50, 50), y[held]
    w = np.array([0.1, math.log(prior / (1 - prior))])
    design = np.stack([t, np.ones_like(t)], 1)
    for _ in range(50):  # Newton steps with a slight pull to 0
        p = _curve(design @ w)
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (p - want) + 1e-3 * w)
        w = w - np.clip(step, -5, 5)
        if abs(step).max() < 1e-9:
            break
    model.slope, model.shift = max(float(w[0]), 1e-3), float(w[1])
    return model


def held_out(doc_id: Column) -> Column:
    """Whether labels of a row are left out of training; rows with a null id are."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Discriminant:
    """Fits on at most ``sample`` labelled documents, the first by a hash of (doc_id, quality), outside the held-out fold.

    Labels other than 0 and 1 are passed over; of several labels for a document each counts. Statistics are made by
    the executors; the driver gets the sample's numbers only.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    # Only hashes below a limit, under which about 1.5 times the sample lies, are sorted at all.
    total = known.count()
    place = F.pmod(F.xxhash64("doc_id", "quality"), F.lit(1 << 30))
    near = known.where(place < int(min(1.0, (1.5 * sample + 1000) / max(total, 1)) * (1 << 30)))
    chosen = near.orderBy(place, "doc_id", "quality").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("body")).join(F.broadcast(chosen), "doc_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f.doc_id, "quality": f.quality, "x": [statistics(t or b"") for t in f.body]})

    # again the first by hash: a document with several rows counts as often, but the driver gets no more than ``sample``
    made = rows.mapInPandas(run, "doc_id long, quality int, x array<double>")
    got = made.orderBy(F.pmod(F.xxhash64("doc_id", "quality"), F.lit(1 << 30)), "doc_id", "quality", "x").limit(sample).toPandas()
    return fit(np.array(got.x.tolist(), float).reshape(-1, len(FEATURES)), got.quality.to_numpy(float))


def scores(text: Column, model: Discriminant) -> Column:
    """Score of each whole text; null counts as empty."""

    @F.pandas_udf("double")
    def run(bodies: pd.Series) -> pd.Series:
        lean_worker()
        return pd.Series(model.score(np.array([statistics(t or b"") for t in bodies], float).reshape(-1, len(FEATURES))))

    return run(text.cast("binary"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Digest of ``documents``: doc_id, held_out, score, predicted. An empty table has no rows."""
    model = train(docs, labels)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scores(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted 1."""
    model = train(docs, labels)
    return docs.where(scores(F.col("text"), model) >= THRESHOLD)

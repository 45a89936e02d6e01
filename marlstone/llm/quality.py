"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored

FEATURES = (
    "log_words", "log_word_length", "word_length_spread", "unique_words", "short_words", "upper", "digits", "stops", "pipes", "loud", "symbols", "lines", "unique_lines", "non_ascii",
)
_CLASSES = np.zeros((256, 7))
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b] = [_b < 128 and _c.isupper(), _b < 128 and _c.isdigit(), _c in ".,;:", _c == "|", _c in "!?", 32 < _b < 127 and not _c.isalnum() and _c not in ".,;:|!?'\"-", _b >= 128]


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of a whole text; a null text counts as empty.

    Sizes are logarithms; shares are smoothed log-odds, which brings them close to a normal distribution.
    """
    data = (text or "").encode()
    kinds = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASSES
    words = data.split()
    n, size = len(words), len(data)
    lengths = np.fromiter(map(len, words), np.float64, n)
    lines = [x for x in data.split(b"\n") if x.strip()]

    def odds(a: float, b: float) -> float:
        return float(np.log((a + 0.5) / (max(b - a, 0) + 1.0)))

    mean = lengths.mean() if n else 0.0
    spread = lengths.std() if n else 0.0
    upper, digits, stops, pipes, loud, symbols, high = kinds
    return np.array([
        np.log1p(n), np.log1p(mean), np.log1p(spread), odds(len(set(words)), n), odds(float((lengths <= 3).sum()), n), odds(upper, size), odds(digits, size),
        odds(stops, size), odds(pipes, size), odds(loud, size), odds(symbols, size), np.log1p(len(lines)), odds(len(set(lines)), len(lines)), odds(high, size),
    ])


@dataclass
class Discriminant:
    """Means, cached Cholesky factors and log-priors of the two classes."""

    means: np.ndarray
    factors: np.ndarray
    logs: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of x, from the difference of the log-densities."""
        dens = []
        for mean, factor, log in zip(self.means, self.factors, self.logs):
            z = np.linalg.solve(factor, (x - mean).T)
            dens.append(log - 0.5 * (z * z).sum(0) - np.log(np.diag(factor)).sum())
        return 1 / (1 + np.exp(np.clip(dens[0] - dens[1], -60, 60)))


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and x array<double>: the statistics of every whole text, written in the shared folder; texts are read once."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [statistics(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["id", "x"])

    return stored(map_batches(docs.select(id_col, text_col), run, f"id {kind}, x array<double>").withColumnRenamed("id", id_col), "statistics")


def fit(labelled: DataFrame, label_col: str, to_class: float = 0.1, to_diagonal: float = 0.02) -> Discriminant | None:
    """Fit on every row (x array<double>) with label 0 or 1; others and nulls are left out. None unless both classes are there.

    Tasks send counts, sums and sums of products of the statistics, which Spark adds up; the driver gets these only.
    Each class's covariance is shrunk towards the pooled one by `to_class` and towards its diagonal by `to_diagonal`.
    """
    d = len(FEATURES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, d + 1, d + 1))
        for batch in batches:
            y = np.array(batch.column(1).to_pylist(), np.int64)
            if len(y):
                x = np.hstack([np.ones((len(y), 1)), np.array(batch.column(0).to_pylist())])
                for k in (0, 1):
                    sums[k] += x[y == k].T @ x[y == k]
        yield pa.RecordBatch.from_pydict({"k": np.arange(sums.size), "v": sums.ravel()})

    rows = labelled.select("x", F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    total = np.zeros(2 * (d + 1) ** 2)
    for r in rows.mapInArrow(moments, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        total[r["k"]] = r["v"]
    s = total.reshape(2, d + 1, d + 1)
    n = s[:, 0, 0]
    if not n.all():
        return None
    means = s[:, 0, 1:] / n[:, None]
    own = s[:, 1:, 1:] / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (own * n[:, None, None]).sum(0) / n.sum()
    factors = []
    for k in (0, 1):
        c = (1 - to_class) * own[k] + to_class * pooled
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(pooled)) + 1e-4 * np.eye(d)
        factors.append(np.linalg.cholesky(c))
    return Discriminant(means, np.array(factors), np.log(n / n.sum()))


def score(statistics_rows: DataFrame, id_col: str, model: Discriminant | None) -> DataFrame:
    """Score described() rows: id column and score double (0 to 1, higher: class 1 likelier).

    A null text counts as empty and is scored too. Without a model every score is 0.5. Repeated rows give repeated
    results; an empty table gives none; other columns of the documents are not read.
    """
    kind = statistics_rows.select(id_col).schema[0].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array(batch.column(1).to_pylist())
        scores = np.full(len(x), 0.5) if model is None else model.scores(x)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    return map_batches(statistics_rows.select(id_col, "x"), run, f"id {kind}, score double").withColumnRenamed("id", id_col)

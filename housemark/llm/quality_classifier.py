"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class is a normal distribution over the transformed statistics. Its covariance is
shrunk towards the diagonal of the pooled one, and factored once; a score is the logistic of
the difference of the log densities (Mahalanobis distances and determinants from the factors)
and of the log shares of the classes.

Training reads every labelled row: sums and products of the statistics are added up before
the shuffle, so one row for each class comes to the driver.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHRINKAGE = 0.1
LEAST_VARIANCE = 1e-3
LEAST_SCORE = 0.3

# Bytes that are counted together.
GROUPS = {
    "upper": bytes(range(65, 91)),
    "digits": bytes(range(48, 58)),
    "symbols": b"#*$%&|<>@^~{}[]\\=+_",
    "stops": b".",
    "commas": b",",
    "shouts": b"!?",
}
N_STATISTICS = 6 + len(GROUPS)


def statistics(raw: bytes | None) -> list[float]:
    """Transformed statistics of a UTF-8 text; all 0 for one without words.

    Length, letters in a word, distinct words, the most frequent word, words equal to the
    one before, repeated lines, and the characters of each group, relative to words.
    """
    raw = raw or b""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * N_STATISTICS
    characters = sum(map(len, words))
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    again = sum(map(bytes.__eq__, words, words[1:]))
    groups = [(len(raw) - len(raw.translate(None, g))) / n for g in GROUPS.values()]
    return [
        np.log1p(n),
        np.log1p(characters / n),
        len(counts) / n,
        np.sqrt(max(counts.values()) / n),
        np.sqrt(again / n),
        np.sqrt(1 - len(set(lines)) / len(lines)),
        *np.log1p(10 * np.array(groups)),
    ]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``statistics``; a null text counts as an empty one.

    An existing column of that name is replaced. Repeated rows have equal statistics, an empty
    table gives an empty one, a text of any length is read whole.
    """
    docs = docs.drop("statistics")
    names = docs.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(names.index(text)).cast(pa.binary()).to_pylist()
            found = pa.array([statistics(x) for x in raw], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*names, "statistics"])

    added = T.StructField("statistics", T.ArrayType(T.DoubleType()))
    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, added]))


@dataclass
class Classes:
    """Log share, mean, Cholesky factor and log determinant of class 0 and of class 1."""

    shares: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of statistics."""
        if not self.means:
            return np.full(len(rows), self.shares[1])
        densities = []
        for share, mean, factor in zip(self.shares, self.means, self.factors):
            solved = np.linalg.solve(factor, (rows - mean).T)
            half = np.log(np.diag(factor)).sum() + 0.5 * (solved**2).sum(axis=0)
            densities.append(np.log(share) - half)
        gap = np.clip(densities[1] - densities[0], -500, 500)
        return 1 / (1 + np.exp(-gap))


def fit(labelled: DataFrame, label: str, shrinkage: float = SHRINKAGE) -> Classes:
    """Classes of the rows whose ``label`` is 0 or 1; others are passed over.

    Repeated rows count each, and so do several labels of one row, conflicting ones in both
    classes. With fewer than two rows of a class there is no density, and every score is the share
    of label 1, one half without any row.
    """
    d = N_STATISTICS
    x = [F.get("statistics", i) for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    rows = (
        labelled.where(F.col(label).isin(0, 1))
        .groupBy(label)
        .agg(
            F.count("*").alias("n"),
            F.array(*(F.sum(v) for v in x)).alias("sums"),
            F.array(*(F.sum(x[i] * x[j]) for i, j in pairs)).alias("products"),
        )
        .collect()
    )
    n = np.zeros(2)
    sums, products = np.zeros((2, d)), np.zeros((2, d, d))
    for row in rows:
        k = int(row[label])
        n[k], sums[k] = row.n, row.sums
        for (i, j), value in zip(pairs, row.products):
            products[k, i, j] = products[k, j, i] = value
    if n.min() < 2:
        share = n[1] / n.sum() if n.sum() else 0.5
        return Classes(np.array([1 - share, share]), [], [])
    means = [sums[k] / n[k] for k in (0, 1)]
    covariances = [products[k] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (n[0] * covariances[0] + n[1] * covariances[1]) / n.sum()
    target = np.diag(np.maximum(np.diag(pooled), LEAST_VARIANCE))
    shrunk = [(1 - shrinkage) * c + shrinkage * target for c in covariances]
    return Classes(n / n.sum(), means, [np.linalg.cholesky(c) for c in shrunk])


def with_scores(docs: DataFrame, classes: Classes) -> DataFrame:
    """``docs``, as ``with_statistics`` gives them, plus ``score``, the probability of class 1.

    Equal statistics have equal scores. An existing column ``score`` is replaced, an empty table
    gives an empty one.
    """
    docs = docs.drop("score")
    names = docs.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(names.index("statistics")).flatten().to_numpy()
            found = pa.array(classes.scores(rows.reshape(-1, N_STATISTICS)))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*names, "score"])

    added = T.StructField("score", T.DoubleType())
    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, added]))

"""Quality by regularised quadratic discriminant analysis.

Each document is reduced to statistics of its characters, words and lines,
transformed to be closer to normal. Per class of the labels, Spark sums the
statistics and their products over all labelled rows; from these come mean and
covariance, shrunk towards the pooled variances. A document's score is the
difference of the two log-densities, each from the Mahalanobis distance by a
Cholesky factor computed once, plus the log of the class sizes.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelmark.llm.common import id_remainder, schema_with
from levelmark.sources.shared import written

FOLDS, HELD_OUT = 3, 1
#: Weight of the pooled variances in a class's covariance, and of the least variance.
SHRINKAGE, FLOOR = 0.1, 1e-4

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
SYMBOLS = b"#$%&*@^~=+<>|\\/_{}[]"
STOPS = b".,;:"
NAMES = (
    "words", "word_length", "upper", "digits", "symbols", "stops", "bangs", "bars", "high_bytes",
    "repeats", "distinct", "line_words", "line_copies", "lone_lines", "symbol_ends",
)


def _share(part: float, whole: float) -> float:
    """Angle of a share: steadies its variance, and is 0 for none."""
    return float(np.arcsin(min(1.0, part / whole) ** 0.5)) if whole else 0.0


def statistics(text: str) -> list[float]:
    """NAMES of one whole text; all zero for an empty one."""
    data, words = text.encode(errors="replace"), text.split()
    size, count = len(data), len(words)
    if not count:
        return [0.0] * len(NAMES)
    lines = [x for x in text.split("\n") if x]
    without = lambda drop: size - len(data.translate(None, drop))
    repeats = sum(map(eq, words, islice(words, 1, None)))
    ends = sum(map(SYMBOL_ENDS.__contains__, [w[-1] for w in words]))
    return [
        float(np.log1p(count)),
        float(np.log(len(text) / count)),
        _share(without(UPPER), size),
        _share(without(DIGITS), size),
        _share(without(SYMBOLS), size),
        _share(without(STOPS), count),
        _share(data.count(b"!"), count),
        _share(data.count(b"|"), count),
        _share(size - len(text), size),
        _share(repeats, count),
        _share(len(set(words)), count),
        float(np.log1p(count / len(lines))),
        _share(len(lines) - len(set(lines)), len(lines)),
        _share(sum(1 for x in lines if " " not in x), len(lines)),
        _share(ends, count),
    ]


SYMBOL_ENDS = frozenset("#$%&*@^~=+<>|\\/_!")


@dataclass
class Discriminant:
    """One Gaussian per class: mean, Cholesky factor of the covariance, log of
    the factor's diagonal and of the class size."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1 for each row."""
        logs = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True):
            distance = np.linalg.solve(factor, (x - mean).T)
            logs.append(offset - 0.5 * np.einsum("ij,ij->j", distance, distance))
        return logs[1] - logs[0]


def discriminant(counts: list[float], sums: list[np.ndarray], products: list[np.ndarray], shrinkage: float = SHRINKAGE) -> Discriminant:
    """From each class's count, sum of the statistics and sum of their products."""
    means = [s / n for n, s in zip(counts, sums, strict=True)]
    spreads = [p / n - np.outer(m, m) for n, m, p in zip(counts, means, products, strict=True)]
    pooled = np.diag(np.mean([np.diag(s) for s in spreads], axis=0))
    shrunk = [(1 - shrinkage) * s + shrinkage * pooled + FLOOR * np.eye(len(s)) for s in spreads]
    factors = [np.linalg.cholesky(s) for s in shrunk]
    offsets = [float(np.log(n) - np.log(np.diag(f)).sum()) for n, f in zip(counts, factors, strict=True)]
    return Discriminant(means, factors, offsets)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and `x`, the statistics of the whole text; null text as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    return texts.mapInArrow(run, schema_with(docs.select("doc_id"), "x array<double>"))


def one_label(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label): one row per id with a label of 0 or 1; of several the larger."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    return rows.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))


def fit(features: DataFrame, labels: DataFrame) -> Discriminant | float:
    """The model over all labelled rows of `features` (doc_id, x); where a class
    has no rows, the share of class 1, or 0.5 without any."""
    pairs = [(i, j) for i in range(len(NAMES)) for j in range(i, len(NAMES))]
    x = F.col("x")
    sums = features.join(labels, "doc_id").groupBy("label").agg(
        F.count("*").alias("n"),
        F.array(*(F.sum(x[i]) for i in range(len(NAMES)))).alias("s"),
        F.array(*(F.sum(x[i] * x[j]) for i, j in pairs)).alias("p"),
    )
    rows = sorted(sums.collect(), key=lambda r: r["label"])  # at most two
    if len(rows) < 2:
        return float(rows[0]["label"]) if rows else 0.5
    products = []
    for row in rows:
        square = np.zeros((len(NAMES), len(NAMES)))
        for (i, j), value in zip(pairs, row["p"], strict=True):
            square[i, j] = square[j, i] = value
        products.append(square)
    return discriminant([float(r["n"]) for r in rows], [np.array(r["s"]) for r in rows], products)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, log_odds.

    Learns from all labelled rows whose crc32(doc_id) modulo `folds` is not
    `held_out`. `score` is the logistic of the log-odds divided by the number of
    statistics (same order, same threshold, no rounding to 0 or 1). Null and
    empty texts are scored as all-zero statistics. With rows of one class only,
    all scores are that class; without labelled rows, 0.5. Only doc_id and text
    are read; repeated rows are scored and learnt from one by one.
    """
    features = written(document_statistics(docs).withColumn("held_out", id_remainder("doc_id", folds) == held_out), "statistics")
    model = fit(features.where(~F.col("held_out")), one_label(labels, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(NAMES))
            if isinstance(model, float):
                odds, score = np.zeros(len(x)), np.full(len(x), model)
            else:
                odds = model.log_odds(x)
                score = 1 / (1 + np.exp(-np.clip(odds / len(NAMES), -700, 700)))
            made = [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(odds)]
            kept = [batch.column("doc_id"), batch.column("held_out")]
            yield pa.RecordBatch.from_arrays([*kept, *made], ["doc_id", "held_out", "score", "predicted", "log_odds"])

    schema = schema_with(features.select("doc_id", "held_out"), "score double, predicted int, log_odds double")
    return features.mapInArrow(run, schema)

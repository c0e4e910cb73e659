"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalsweep.llm.common import map_batches, staged, text_bytes
from evalsweep.llm.labels import held_out, training_labels

# Kinds of bytes whose shares are statistics of their own.
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "line": b"\n",
    "stop": b".",
    "comma": b",;:",
    "exclaim": b"!",
    "question": b"?",
    "bar": b"|",
    "symbol": b"#$%&*+=@^_~<>/\\",
    "bracket": b"()[]{}",
    "quote": b"\"'`-",
}
NAMES = [
    *KINDS, "other", "wide", "bytes", "word_length", "long_words", "distinct_words",
    "distinct_lines", "line_words", "capital_words", "ended_lines",
]
_KIND = np.full(256, len(KINDS), np.uint8)  # small letters and control characters
for _i, _bytes in enumerate(KINDS.values()):
    _KIND[list(_bytes)] = _i
_KIND[128:] = len(KINDS) + 1


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text; null counts as empty."""
    data, offsets = text_bytes(column)
    n, sizes = len(offsets) - 1, np.diff(offsets)
    doc = np.repeat(np.arange(n) * (len(KINDS) + 2), sizes)
    counts = np.bincount(doc + _KIND[data], minlength=n * (len(KINDS) + 2)).reshape(n, -1)
    shares = np.log((counts + 0.1) / (sizes[:, None] + 10.0))
    rows = []
    for text in column.to_pylist():
        text = text or ""
        words, lines = text.split(), text.split("\n")
        n_words, letters = len(words), sum(map(len, words))
        distinct, filled = len(set(words)), [line for line in lines if line]
        rows.append(
            (
                np.log1p(len(text)),
                np.log((letters + 5.0) / (n_words + 1.0)),
                np.log((sum(len(w) > 12 for w in words) + 0.5) / (n_words + 10.0)),
                np.log((distinct + 1.0) / (n_words + 1.0)),
                np.log((len(set(filled)) + 1.0) / (len(filled) + 1.0)),
                np.log((n_words + 1.0) / (len(filled) + 1.0)),
                np.log((sum(w[0].isupper() for w in words) + 0.5) / (n_words + 10.0)),
                np.log((sum(line[-1] in ".!?" for line in filled) + 0.5) / (len(filled) + 1.0)),
            )
        )
    return np.hstack([shares, np.array(rows, np.float64).reshape(n, -1)])


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors of the shrunken covariances, and log constants."""

    means: np.ndarray
    whiteners: np.ndarray
    constants: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log of the odds of class 1, from Mahalanobis distances to both classes."""
        sides = []
        for mean, whiten, constant in zip(self.means, self.whiteners, self.constants):
            z = (x - mean) @ whiten.T
            sides.append(constant - 0.5 * np.einsum("ij,ij->i", z, z))
        return sides[1] - sides[0]


def solve(
    n: np.ndarray, sums: np.ndarray, squares: np.ndarray, to_pooled: float, to_round: float
) -> Discriminant | float:
    """Discriminant from counts, sums and sums of outer products of both classes.

    Each covariance is shrunk to the pooled one by ``to_pooled``, then to a
    multiple of the identity by ``to_round``.  With fewer than two rows in a
    class there is nothing to tell apart: the smoothed share of class 1 instead.
    """
    if min(n) < 2:
        return float((n[1] + 1.0) / (n.sum() + 2.0))
    means = sums / n[:, None]
    each = squares / n[:, None, None] - np.einsum("ki,kj->kij", means, means)
    pooled = np.einsum("k,kij->ij", n, each) / n.sum()
    whiteners, constants = [], []
    for k in (0, 1):
        cov = (1 - to_pooled) * each[k] + to_pooled * pooled
        scale = np.trace(cov) / len(cov)
        cov = (1 - to_round) * cov + (to_round * scale + 1e-9) * np.eye(len(cov))
        factor = np.linalg.cholesky((cov + cov.T) / 2)
        whiteners.append(np.linalg.inv(factor))
        constants.append(np.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(whiteners), np.array(constants))


def fit(features: DataFrame, to_pooled: float = 0.1, to_round: float = 0.02) -> Discriminant | float:
    """Fit on all ``(x, y)`` rows: tasks add up moments, the driver gets two matrices per task."""
    dim = len(NAMES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = np.zeros(2), np.zeros((2, dim)), np.zeros((2, dim, dim))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch), batch.column("y").to_numpy()
            for k in (0, 1):
                own = x[y == k]
                n[k] += len(own)
                sums[k] += own.sum(0)
                squares[k] += own.T @ own
        flat = np.concatenate([n, sums.ravel(), squares.ravel()])
        yield pa.RecordBatch.from_pydict({"sums": pa.array([flat], pa.list_(pa.float64()))})

    total = np.zeros(2 + 2 * dim + 2 * dim * dim)
    for row in features.select("x", "y").mapInArrow(moments, "sums array<double>").toLocalIterator():
        total += np.array(row["sums"])
    return solve(
        total[:2],
        total[2 : 2 + 2 * dim].reshape(2, dim),
        total[2 + 2 * dim :].reshape(2, dim, dim),
        to_pooled,
        to_round,
    )


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row.

    The score is the probability of ``quality`` 1 given the text's statistics
    alone.  Rows whose id has crc32 0 modulo 5 never train.  Null and empty texts
    have the statistics of an empty text; a null id is not held out and never
    trains; repeated rows are scored each and train each.  A score equal to the
    threshold is predicted 1.  Texts of any length are measured whole; other columns
    of both tables are left out; an empty table gives no rows.  Without labels of
    both classes every score is the share of 1 among them, smoothed.
    """

    def work(batch: pa.RecordBatch) -> dict:
        x = statistics(batch.column("text"))
        return {"doc_id": batch.column("doc_id"), "x": list(x)}

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    features = staged(map_batches(rows, work, "doc_id long, x array<double>"), "quality-statistics")
    model = fit(features.join(training_labels(labels, "quality", 5, 0), "doc_id"))

    def score(batch: pa.RecordBatch) -> dict:
        if isinstance(model, float):
            values = np.full(batch.num_rows, model)
        else:
            odds = np.clip(model.log_odds(_matrix(batch)), -700, 700)
            values = 1.0 / (1.0 + np.exp(-odds))
        return {
            "doc_id": batch.column("doc_id"),
            "score": values,
            "predicted": (values >= threshold).astype(np.int32),
        }

    scored = map_batches(features, score, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")

"""Small numpy models and the bounded labelled sample they are fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], max_rows: int, where=None, extra: list[str] | None = None) -> DataFrame:
    """(doc_id, text, *extra, *columns) of at most max_rows labelled documents, the least by a hash of doc_id.

    Several labels of one document count by their mean (rounded, halves up); null labels and null ids are left out.
    Of several rows of one doc_id the one of the least hash of its text counts, so max_rows bounds rows too, and at most
    so many ids are broadcast, whatever the size of docs."""
    marks = labels.where(F.col("doc_id").isNotNull())
    if where is not None:
        marks = marks.where(where)
    marks = marks.groupBy("doc_id").agg(*[F.floor(F.avg(c) + 0.5).cast("int").alias(c) for c in columns]).dropna()
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(extra or []))
    names = [c for c in plain.columns if c != "doc_id"]
    one = plain.join(F.broadcast(marks.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("_h"), *names)).alias("_r"))
    sample = one.select("doc_id", *[F.col(f"_r.{c}").alias(c) for c in names]).join(F.broadcast(marks), "doc_id")
    return Scratch(docs.sparkSession, "sample").save(sample, "sample")  # read several times


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class SparseRows:
    """Rows of (column, value) pairs with dense columns beside them."""

    def __init__(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, shape: tuple[int, int], dense: np.ndarray | None = None):
        self.row, self.col, self.val, self.shape = row, col, val, shape
        self.dense = np.zeros((shape[0], 0)) if dense is None else dense

    def take(self, keep: np.ndarray) -> SparseRows:
        place = np.full(self.shape[0], -1)
        place[keep] = np.arange(len(keep))
        mine = place[self.row] >= 0
        return SparseRows(place[self.row[mine]], self.col[mine], self.val[mine], (len(keep), self.shape[1]), self.dense[keep])

    def with_dense(self, dense: np.ndarray) -> SparseRows:
        return SparseRows(self.row, self.col, self.val, self.shape, np.column_stack((self.dense, dense)))

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.bincount(self.row, weights=self.val * w[self.col], minlength=self.shape[0])
        return out + self.dense @ w[self.shape[1] :] if self.dense.shape[1] else out

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.concatenate((np.bincount(self.col, weights=self.val * g[self.row], minlength=self.shape[1]), self.dense.T @ g))


def fit_logistic(x: SparseRows, y: np.ndarray, l2: float = 1e-5, rounds: int = 100, rate: float = 0.2) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the mean log loss. With one class only: no weights and the smoothed base rate."""
    n, w = len(y), np.zeros(x.shape[1] + x.dense.shape[1])
    base = (y.sum() + 0.5) / (n + 1.0)
    b = float(np.log(base / (1 - base)))
    if n == 0 or y.min() == y.max():
        return w, b
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        d = (sigmoid(x.dot(w) + b) - y) / n
        g, gb = x.back(d) + l2 * w, float(d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (vb / c2) ** 0.5 if vb else 0.0
    return w, b

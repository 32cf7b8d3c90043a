"""Logistic regression on soft labels, by numpy, and bounded training samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Classes up to this number are broadcast with their counts; above it they are joined by shuffle.
BROADCAST_CLASSES = 10_000


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class Sparse:
    """Entries (row, column, value)."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int]):
        self.rows, self.columns, self.values, self.shape = rows, columns, values, shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.columns], self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * g[self.rows], self.shape[1])


class Dense:
    def __init__(self, x: np.ndarray):
        self.x, self.shape = x, x.shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w.astype(self.x.dtype)

    def back(self, g: np.ndarray) -> np.ndarray:
        return self.x.T @ g.astype(self.x.dtype)


def fit(x: Sparse | Dense, target: np.ndarray, weight: np.ndarray, penalty: float = 1.0, steps: int = 120) -> tuple[np.ndarray, float]:
    """Weights and bias of the least penalised logistic loss, by accelerated gradient steps with a falling-back restart."""
    w, b = np.zeros(x.shape[1]), 0.0
    v, c = w.copy(), b
    momentum, rate, last = 1.0, 1.0, np.inf

    def loss(w: np.ndarray, b: float, z: np.ndarray) -> float:
        return float(weight @ (np.logaddexp(0, z) - target * z)) + 0.5 * penalty * float(w @ w)

    for _ in range(steps):
        z = x.dot(v) + c
        g = weight * (sigmoid(z) - target)
        gw, gb = x.back(g) + penalty * v, float(g.sum())
        here = loss(v, c, z)
        norm = float(gw @ gw) + gb * gb
        if norm < 1e-10:
            break
        while True:
            w2, b2 = v - rate * gw, c - rate * gb
            now = loss(w2, b2, x.dot(w2) + b2)
            if now <= here - 0.5 * rate * norm or rate < 1e-9:
                break
            rate *= 0.5
        if now > last:
            momentum = 1.0
        step = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        v, c = w2 + (momentum - 1) / step * (w2 - w), b2 + (momentum - 1) / step * (b2 - b)
        w, b, momentum, last = w2, b2, step, now
        rate *= 1.3
    return w, b


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text has that remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == part


def sample_by_class(rows: DataFrame, class_col: str, id_col: str, most: int, in_all: int) -> DataFrame:
    """About `most` rows of each class, fewer where there are many classes, chosen by a hash of the id.

    The classes are counted over all rows; a row's chance is the bound over its class's count. Rows without a class are
    left out; without classes there are no rows. Of many classes each keeps a row at least, by chance.
    """
    known = rows.where(F.col(class_col).isNotNull())
    counts = known.groupBy(F.col(class_col).alias("__class")).agg(F.count(F.lit(1)).alias("__n"))
    n_classes = counts.count()
    bound = max(1, min(most, in_all // max(1, n_classes)))
    chance = (F.least(F.lit(1.0), bound / F.col("__n")) * (1 << 30)).cast("long")
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 30))
    table = F.broadcast(counts) if n_classes <= BROADCAST_CLASSES else counts
    return known.join(table, F.col(class_col) == F.col("__class")).where(drawn < chance).drop("__class", "__n")

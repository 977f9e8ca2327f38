"""Bounded training samples and small numpy optimisers shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit_hash(*columns: str, seed: int = 5) -> Column:
    """A uniform number in [0, 1) from a row's own values: the same for every partitioning."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / float(1 << 53)


def share_for(limit: int, count: int) -> float:
    return 1.0 if count <= limit else limit / count


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float = 0.01):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        a, b = 1 - 0.9**self.t, 1 - 0.999**self.t
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / a) / (np.sqrt(v / b) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def area_under_curve(label: np.ndarray, score: np.ndarray) -> float:
    """Probability that a random positive outranks a random negative (ties count half)."""
    order = np.argsort(score, kind="stable")
    _, first, counts = np.unique(score[order], return_index=True, return_counts=True)
    rank = np.empty(len(score))
    rank[order] = np.repeat(first + (counts + 1) / 2, counts)
    pos = label == 1
    n, m = pos.sum(), (~pos).sum()
    return float((rank[pos].sum() - n * (n + 1) / 2) / (n * m)) if n and m else float("nan")


def first_rows(df: DataFrame, limit: int, *columns: str) -> DataFrame:
    """At most ``limit`` rows, in an order that follows from their values alone: the same for every partitioning."""
    return df.orderBy(F.xxhash64(*columns), *columns).limit(limit)

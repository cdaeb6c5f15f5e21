"""Bounded samples of rows for fitting classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_labels(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int) -> DataFrame:
    """text and y of at most `most` documents of each value of the label, by a hash of doc_id, among labels that `train` allows.

    Labels that are null don't count; of rows that repeat a doc_id the first text is taken. `train` is a condition on doc_id. The keys are bounded by 2 * most,
    so their join broadcasts, and each task keeps the first `most` of its own rows only.
    """
    known = labels.where(train).select("doc_id", F.col(label).alias("y")).distinct()
    few = [known.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for v in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(few[0].unionByName(few[1])), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("text", "y")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    def __init__(self, parameters: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = parameters, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.v = {k: np.zeros_like(v) for k, v in parameters.items()}

    def step(self, gradient: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in gradient.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)

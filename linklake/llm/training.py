"""Bounded training samples, and the Adam steps that the numpy models share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable, per_class: int, longest: int) -> list[tuple[str, int]]:
    """At most ``per_class`` (text, label) of each class, in a fixed order.

    Rows are taken by the hash of their id among those that ``usable`` admits; texts over ``longest``
    characters and rows with a null id, label or text are passed over. What reaches the driver is so bounded.
    """
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & usable).select("doc_id", F.col(label).cast("int").alias("label"))
    fits = docs.filter(F.col("text").isNotNull() & (F.length("text") <= longest)).select("doc_id", F.length("text").alias("size"))
    rows = rows.join(fits.select("doc_id"), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    taken = None
    for y in (0, 1):
        some = rows.filter(F.col("label") == y).distinct().orderBy(*order).limit(per_class)
        taken = some if taken is None else taken.union(some)
    found = docs.filter(F.col("text").isNotNull() & (F.length("text") <= longest)).select("doc_id", "text").join(taken, "doc_id")
    found = found.dropDuplicates(["doc_id"]).toPandas()
    found = found.sort_values("doc_id")
    return list(zip(found["text"].tolist(), found["label"].tolist(), strict=True))


class Adam:
    """Adam steps over a dict of arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float, decay: float = 0.0):
        self.weights, self.rate, self.decay, self.t = weights, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            g = g + self.decay * self.weights[k]
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            self.weights[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(self.weights[k].dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

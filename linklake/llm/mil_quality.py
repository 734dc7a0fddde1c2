"""Document quality by attention-based multiple-instance learning (Ilse et al., 2018), trained in numpy.

Method: a text is a bag of passages. Every passage is encoded from the shares of its pairs of character
classes and a few measures of repetition; gated attention, learned from document labels alone, weighs
the passages; a logistic unit scores the weighted mean. All passages of every text are encoded.

Only the text is read. The training sample is bounded by ``PER_CLASS`` documents of each class and
``LONGEST`` characters a document.

Defined results: a null or empty text is one empty passage and gets that passage's score. If either
class has no training rows, all scores are 0.5. Repeated rows get equal scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .training import Adam, labelled_sample, sigmoid
from .words import portions

PASSAGE = 1024  # bytes; a passage ends at the first white space from there on
SYMBOLS = b"#*$%&|<>!.,?-_'\":;()/"
HIDDEN, ATTENTION = 24, 12
PER_CLASS = 1200
LONGEST = 200_000
EPOCHS = 40
BATCH = 64


def _classes() -> np.ndarray:
    """Class of each byte: lower, upper, digit, space, line end, other letters' bytes, other, and each symbol apart."""
    out = np.full(256, 6, np.int64)
    for b in range(256):
        if 97 <= b <= 122:
            out[b] = 0
        elif 65 <= b <= 90:
            out[b] = 1
        elif 48 <= b <= 57:
            out[b] = 2
        elif b in b" \t":
            out[b] = 3
        elif b in b"\n\r":
            out[b] = 4
        elif b >= 128:
            out[b] = 5
        elif b in SYMBOLS:
            out[b] = 7 + SYMBOLS.index(b)
    return out


CLASSES = _classes()
N = 7 + len(SYMBOLS)
EXTRA = 6
SIZE = N * N + EXTRA


def passages(data: bytes) -> list[bytes]:
    """Consecutive passages that make up the whole text."""
    out, at = [], 0
    while len(data) - at > PASSAGE:
        end = at + PASSAGE
        cuts = [k for k in (data.find(b" ", end), data.find(b"\n", end)) if k >= 0]
        end = min(cuts) + 1 if cuts else len(data)
        out.append(data[at:end])
        at = end
    if at < len(data) or not out:
        out.append(data[at:])
    return out


def _measures(part: bytes) -> list[float]:
    words = part.split()
    if not words:
        return [0.0] * EXTRA
    lines = [x for x in part.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        len(set(words)) / len(words), pairs / max(1, len(words) - 1), len(set(lines)) / max(1, len(lines)),
        min(1.0, len(part) / len(words) / 20), min(1.0, max(map(len, words)) / 100), min(1.0, len(lines) / 20),
    ]


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of all passages, and the number of passages of each text."""
    bags = [passages((t or "").encode("utf-8", "replace")) for t in texts]
    flat = [p for bag in bags for p in bag]
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    kinds = CLASSES[np.frombuffer(b"".join(flat), np.uint8)]
    owner = np.repeat(np.arange(len(flat)), sizes)
    code = owner[1:] * (N * N) + kinds[:-1] * N + kinds[1:]
    code = code[owner[1:] == owner[:-1]]
    counts = np.bincount(code, minlength=len(flat) * N * N).reshape(len(flat), N * N)
    shares = np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True))).astype(np.float32)
    extra = np.array([_measures(p) for p in flat], np.float32).reshape(len(flat), EXTRA)
    return np.hstack([shares, extra]), np.fromiter(map(len, bags), np.int64, len(bags))


def new_weights(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def normal(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) * shape[0] ** -0.5).astype(np.float32)

    return {
        "enc": normal(SIZE, HIDDEN) * 3, "enc_bias": np.zeros(HIDDEN, np.float32), "tanh": normal(HIDDEN, ATTENTION),
        "gate": normal(HIDDEN, ATTENTION), "query": normal(ATTENTION), "out": normal(HIDDEN), "out_bias": np.zeros(1, np.float32),
    }


def forward(w: dict, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Logit of each bag of consecutive rows of ``x``."""
    starts = np.cumsum(counts) - counts
    hidden = np.tanh(x @ w["enc"] + w["enc_bias"])
    side, gate = np.tanh(hidden @ w["tanh"]), sigmoid(hidden @ w["gate"])
    marks = (side * gate) @ w["query"]
    share = np.exp(marks - np.repeat(np.maximum.reduceat(marks, starts), counts))
    share /= np.repeat(np.add.reduceat(share, starts), counts)
    pooled = np.add.reduceat(share[:, None] * hidden, starts, axis=0)
    return pooled @ w["out"] + w["out_bias"][0], (starts, hidden, side, gate, share, pooled)


def backward(w: dict, x: np.ndarray, counts: np.ndarray, kept: tuple, slope: np.ndarray) -> dict[str, np.ndarray]:
    starts, hidden, side, gate, share, pooled = kept
    to_pooled = np.repeat(slope[:, None] * w["out"], counts, axis=0)
    to_share = (hidden * to_pooled).sum(axis=1)
    to_marks = share * (to_share - np.repeat(np.add.reduceat(share * to_share, starts), counts))
    to_both = to_marks[:, None] * w["query"]
    to_side, to_gate = to_both * gate * (1 - side**2), to_both * side * gate * (1 - gate)
    to_hidden = share[:, None] * to_pooled + to_side @ w["tanh"].T + to_gate @ w["gate"].T
    to_in = to_hidden * (1 - hidden**2)
    return {
        "enc": x.T @ to_in, "enc_bias": to_in.sum(axis=0), "tanh": hidden.T @ to_side, "gate": hidden.T @ to_gate,
        "query": (side * gate).T @ to_marks, "out": pooled.T @ slope, "out_bias": slope.sum(keepdims=True),
    }


def train(sample: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 5) -> dict[str, np.ndarray] | None:
    """Weights from (text, 0 or 1); None if a class is missing."""
    labels = np.array([y for _, y in sample], np.float32)
    if not len(labels) or labels.min() == labels.max():
        return None
    x, counts = encode([t for t, _ in sample])
    ends = np.cumsum(counts)
    weights, rng = new_weights(seed), np.random.default_rng(seed)
    adam = Adam(weights, 0.004, 1e-5)
    share = labels.mean()
    for epoch in range(epochs):
        adam.rate = 0.004 * (1 - 0.9 * epoch / epochs)
        order = rng.permutation(len(labels))
        for i in range(0, len(order), BATCH):
            bags = order[i : i + BATCH]
            rows = np.concatenate([np.arange(ends[b] - counts[b], ends[b]) for b in bags])
            logit, kept = forward(weights, x[rows], counts[bags])
            y = labels[bags]
            weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
            slope = ((sigmoid(logit) - y) * weight / len(bags)).astype(np.float32)
            adam.step(backward(weights, x[rows], counts[bags], kept, slope))
    return weights


def score_texts(texts: list[str | None], weights: dict[str, np.ndarray] | None) -> np.ndarray:
    if weights is None:
        return np.full(len(texts), 0.5)
    out = [sigmoid(forward(weights, *encode(some))[0].astype(np.float64)) for some in portions(texts, 4_000_000)]
    return np.concatenate(out) if out else np.zeros(0)


def scores(text: str | Column, weights: dict[str, np.ndarray] | None) -> Column:
    """The score of a text column by a trained model, which the function carries (under 100 KB)."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(texts.tolist(), weights), dtype="float64")

    return F.pandas_udf(run, "double")(F.col(text) if isinstance(text, str) else text)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = PER_CLASS) -> dict[str, np.ndarray] | None:
    """Train on the labelled rows that ``usable`` admits."""
    return train(labelled_sample(docs, labels, "quality", usable, per_class, LONGEST))

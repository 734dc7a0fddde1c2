"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Method: a word enters the network as the sum of what is known of the whole word (an embedding, for words that
several training documents hold) and of its letters (a sum of embeddings of hashed letter triples with
the word's borders). Two gated recurrent layers read a window of words in either direction, attention
pools their states, and a logistic unit scores the window. Windows overlap and cover the whole text; a document's
score is that of its worst window. In training, the loss of a toxic document falls on its worst
windows and that of a clean one on the windows that look worst.

Only the text is read. The training sample is bounded by ``PER_CLASS`` documents of each class and
``LONGEST`` characters a document; scoring reads every text whole.

Defined results: null, empty and wordless texts get the score of an empty window. If either class has no
training rows, all scores are 0. Repeated rows get equal scores.
"""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .training import Adam, labelled_sample, sigmoid
from .words import portions

WINDOW, STRIDE = 96, 80
HIDDEN = 8
WORD_SIZE = 16
TRIPLES = 8192
VOCABULARY = 20_000
LEAST_DOCUMENTS = 4
PER_CLASS = 800
LONGEST = 200_000
EPOCHS = 10
BATCH = 64
LEAST_STEPS = 500
#: Characters and windows that are scored at once; a worker holds their words and states several times over.
PORTION = 1_000_000
PORTION_WINDOWS = 512
_PLAIN = bytes.maketrans(
    bytes(x for x in range(128) if not chr(x).isalnum()), b" " * sum(not chr(x).isalnum() for x in range(128))
)


def split_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_PLAIN).split()


# --- word inputs -------------------------------------------------------------------------


def triples(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter triples of every word with its borders, end to end, and where each word starts."""
    flat = np.frombuffer(b"".join([b"^" + w + b"$" for w in words]), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    code = (flat[:-2] << 16) | (flat[1:-1] << 8) | flat[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - TRIPLES.bit_length() + 1)
    inside = np.ones(len(flat), bool)
    inside[ends - 1] = inside[ends - 2] = False  # triples that would run into the next word
    starts = np.concatenate([[0], np.cumsum(lengths - 2)[:-1]])
    return code[inside[:-2]], starts


class Inputs:
    """A list of distinct words with their places in the vocabulary and their letter triples."""

    def __init__(self, words: list[bytes], vocabulary: dict[bytes, int]):
        self.known = np.fromiter((vocabulary.get(w, 0) for w in words), np.int64, len(words))
        self.buckets, self.starts = triples(words) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def vectors(self, weights: dict[str, np.ndarray]) -> np.ndarray:
        if not len(self.known):
            return np.zeros((0, WORD_SIZE), np.float32)
        return weights["word"][self.known] + np.add.reduceat(weights["letter"][self.buckets], self.starts, axis=0)

    def spread(self, grad: np.ndarray, weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        word, letter = np.zeros_like(weights["word"]), np.zeros_like(weights["letter"])
        np.add.at(word, self.known, grad)
        word[0] = 0
        counts = np.diff(np.append(self.starts, len(self.buckets)))
        np.add.at(letter, self.buckets, np.repeat(grad, counts, axis=0))
        return {"word": word, "letter": letter}


# --- the network -------------------------------------------------------------------------


def new_weights(words: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    h = HIDDEN
    out = {"word": normal(words + 1, WORD_SIZE, scale=0.1), "letter": normal(TRIPLES, WORD_SIZE, scale=0.1)}
    out["word"][0] = 0
    for side in "fb":
        out[f"in_{side}"] = normal(WORD_SIZE, 3 * h, scale=WORD_SIZE**-0.5)
        out[f"bias_{side}"] = np.zeros(3 * h, np.float32)
        out[f"state_{side}"] = normal(h, 3 * h, scale=h**-0.5)
    out |= {"mix": normal(2 * h, h, scale=(2 * h) ** -0.5), "query": normal(h, scale=h**-0.5)}
    return out | {"out": normal(2 * h, scale=(2 * h) ** -0.5), "out_bias": np.full(1, -1, np.float32)}


def read(weights: dict, side: str, gates: np.ndarray, places: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, window, hidden) of one direction. ``gates``: each distinct word's share of the gates."""
    times, n = places.shape
    h, state, us = HIDDEN, np.zeros((n, HIDDEN), np.float32), weights[f"state_{side}"]
    states = np.zeros((times, n, h), np.float32)
    for t in range(times) if side == "f" else range(times - 1, -1, -1):
        x, own = gates[places[t]], state @ us
        ru = x[:, : 2 * h] + own[:, : 2 * h]
        ru *= 0.5  # the logistic function by way of tanh, which numpy vectorises
        np.tanh(ru, out=ru)
        ru += 1
        ru *= 0.5
        r, u = ru[:, :h], ru[:, h:]
        new = np.tanh(x[:, 2 * h :] + r * own[:, 2 * h :])
        m = mask[t][:, None]
        if keep is not None:
            keep.append((t, state, r, u, new, own[:, 2 * h :], m))
        state = state + m * ((1 - u) * (new - state))
        states[t] = state
    return states


def forward(weights: dict, vectors: np.ndarray, places: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logit of every window. ``places`` (time, window) index the rows of ``vectors``; ``mask`` marks real words."""
    both = []
    for side in "fb":
        steps = None if keep is None else []
        both.append(read(weights, side, vectors @ weights[f"in_{side}"] + weights[f"bias_{side}"], places, mask, steps))
        if keep is not None:
            keep[side] = steps
    states = np.concatenate(both, axis=2)
    mixed = np.tanh(states @ weights["mix"])
    marks = np.where(mask > 0, mixed @ weights["query"], -1e4)
    share = np.exp(marks - marks.max(axis=0))
    share /= share.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", share, states)
    if keep is not None:
        keep |= {"states": states, "mixed": mixed, "share": share, "pooled": pooled}
    return pooled @ weights["out"] + weights["out_bias"][0]


def backward(weights: dict, inputs: Inputs, vectors: np.ndarray, places: np.ndarray, mask: np.ndarray, keep: dict, slope: np.ndarray) -> dict:
    """Gradients of a loss whose derivative by each window's logit is ``slope``."""
    h = HIDDEN
    states, mixed, share, pooled = keep["states"], keep["mixed"], keep["share"], keep["pooled"]
    grads = {"out": pooled.T @ slope, "out_bias": slope.sum(keepdims=True)}
    to_pooled = slope[:, None] * weights["out"]
    to_states = share[:, :, None] * to_pooled
    to_share = np.einsum("tnh,nh->tn", states, to_pooled)
    to_marks = np.where(mask > 0, share * (to_share - (share * to_share).sum(axis=0)), 0)
    grads["query"] = np.einsum("tn,tnh->h", to_marks, mixed)
    to_mixed = to_marks[:, :, None] * weights["query"] * (1 - mixed**2)
    grads["mix"] = np.einsum("tna,tnb->ab", states, to_mixed)
    to_states = to_states + to_mixed @ weights["mix"].T
    to_vectors = np.zeros_like(vectors)
    for side, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
        us, carry = weights[f"state_{side}"], np.zeros((places.shape[1], h), np.float32)
        to_gates, to_us = np.zeros((len(vectors), 3 * h), np.float32), np.zeros_like(us)
        for t, before, r, u, new, own_n, m in reversed(keep[side]):
            carry = carry + to_states[t][:, part]
            to_new = carry * m * (1 - u) * (1 - new**2)
            to_u = carry * m * (before - new) * u * (1 - u)
            to_r = to_new * own_n * r * (1 - r)
            to_own = np.concatenate([to_r, to_u, to_new * r], axis=1)
            to_us += before.T @ to_own
            np.add.at(to_gates, places[t], np.concatenate([to_r, to_u, to_new], axis=1))
            carry = carry * (1 - m * (1 - u)) + to_own @ us.T
        grads[f"state_{side}"] = to_us
        grads[f"bias_{side}"] = to_gates.sum(axis=0)
        grads[f"in_{side}"] = vectors.T @ to_gates
        to_vectors += to_gates @ weights[f"in_{side}"].T
    return grads | inputs.spread(to_vectors, weights)


# --- windows -----------------------------------------------------------------------------


class Windows:
    """The overlapping windows of many texts over one list of distinct words."""

    def __init__(self, texts: list[list[bytes]], vocabulary: dict[bytes, int]):
        flat = list(itertools.chain.from_iterable(texts))
        seen: dict[bytes, int] = {}
        first = np.fromiter(map(seen.setdefault, flat, itertools.count()), np.int64, len(flat))
        distinct, self.flat = np.unique(first, return_inverse=True)
        self.inputs = Inputs([flat[i] for i in distinct.tolist()], vocabulary)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        counts = np.maximum(1, -(-(lengths - WINDOW) // STRIDE) + 1)
        self.owner = np.repeat(np.arange(len(texts)), counts)
        rank = np.arange(len(self.owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = np.cumsum(lengths) - lengths
        # the last window ends with the text
        at = np.minimum(rank * STRIDE, np.maximum(lengths[self.owner] - WINDOW, 0))
        self.start, self.size = begin[self.owner] + at, np.minimum(lengths[self.owner], WINDOW)

    def block(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and mask, (time, window); an empty window holds the row after the last word, without a mask."""
        steps = np.arange(max(1, int(self.size[which].max(initial=1))))[:, None]
        mask = steps < self.size[which]
        at = np.where(mask, self.start[which] + steps, 0)
        places = np.where(mask, self.flat[at] if len(self.flat) else 0, len(self.inputs.known))
        return places, mask.astype(np.float32)


def _with_blank(vectors: np.ndarray) -> np.ndarray:
    return np.vstack([vectors, np.zeros((1, vectors.shape[1]), np.float32)]).astype(np.float32)


def window_logits(weights: dict, windows: Windows, block: int = 2048) -> np.ndarray:
    vectors = _with_blank(windows.inputs.vectors(weights))
    gates = {s: vectors @ weights[f"in_{s}"] + weights[f"bias_{s}"] for s in "fb"}
    out = np.zeros(len(windows.owner), np.float32)
    order = np.argsort(windows.size, kind="stable")
    for i in range(0, len(order), block):
        which = order[i : i + block]
        places, mask = windows.block(which)
        states = np.concatenate([read(weights, s, gates[s], places, mask) for s in "fb"], axis=2)
        marks = np.where(mask > 0, np.tanh(states @ weights["mix"]) @ weights["query"], -1e4)
        share = np.exp(marks - marks.max(axis=0))
        share /= share.sum(axis=0)
        out[which] = (share * (states @ weights["out"])).sum(axis=0) + weights["out_bias"][0]
    return out


def train(sample: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 7) -> tuple[dict[bytes, int], dict] | None:
    """Vocabulary and weights from (text, 0 or 1); None if a class is missing."""
    labels = np.array([y for _, y in sample], np.float32)
    if not len(labels) or labels.min() == labels.max():
        return None
    texts = [split_words(t) for t, _ in sample]
    often = Counter(itertools.chain.from_iterable(map(set, texts)))
    most = sorted((w for w, n in often.items() if n >= LEAST_DOCUMENTS), key=lambda w: (-often[w], w))[:VOCABULARY]
    vocabulary = {w: k + 1 for k, w in enumerate(most)}
    windows, weights = Windows(texts, vocabulary), new_weights(len(vocabulary), seed)
    rng, adam = np.random.default_rng(seed), Adam(weights, 0.01, 1e-5)
    spans = np.searchsorted(windows.owner, np.arange(len(texts) + 1))
    epochs = max(epochs, min(4 * epochs, LEAST_STEPS * BATCH // (2 * len(texts))))  # more turns for a small sample
    for epoch in range(epochs):
        adam.rate = 0.01 * (1 - 0.8 * epoch / epochs)
        logits = window_logits(weights, windows) if epoch else rng.standard_normal(len(windows.owner))
        chosen = []
        for d in range(len(texts)):
            own = np.arange(spans[d], spans[d + 1])
            worst = own[np.argsort(-logits[own], kind="stable")]
            chosen.append(worst[: 1 if labels[d] else 2])
            chosen.append(rng.choice(own, 1))
        chosen = np.concatenate(chosen)
        # a toxic document's random window may be clean: it counts only while the network knows nothing better
        sure = (labels[windows.owner[chosen]] == 0) | (epoch == 0)
        if epoch:
            top = np.maximum.reduceat(logits, spans[:-1])
            sure |= logits[chosen] >= top[windows.owner[chosen]] - 1e-6
        chosen = rng.permutation(np.unique(chosen[sure]))
        target = labels[windows.owner[chosen]]
        weight = np.where(target == 1, (target == 0).sum() / max(1, (target == 1).sum()), 1).clip(1, 4)
        for i in range(0, len(chosen), BATCH):
            which = chosen[i : i + BATCH]
            places, mask = windows.block(which)
            used, local = np.unique(places, return_inverse=True)
            some = _Part(windows.inputs, used)
            vectors = some.vectors(weights).astype(np.float32)
            keep: dict = {}
            logit = forward(weights, vectors, local.reshape(places.shape), mask, keep)
            slope = ((sigmoid(logit) - target[i : i + BATCH]) * weight[i : i + BATCH] / len(which)).astype(np.float32)
            adam.step(backward(weights, some, vectors, local.reshape(places.shape), mask, keep, slope))
    return vocabulary, weights


class _Part(Inputs):
    """Some words of an input list; a place after its end is the blank word, without letters."""

    def __init__(self, whole: Inputs, used: np.ndarray):
        real = used[used < len(whole.known)]
        self.blank = len(real) < len(used)
        self.known = whole.known[real]
        ends = np.append(whole.starts, len(whole.buckets))
        counts = ends[real + 1] - ends[real]
        self.starts = np.cumsum(counts) - counts
        self.buckets = whole.buckets[np.repeat(ends[real] - self.starts, counts) + np.arange(counts.sum())]

    def vectors(self, weights: dict) -> np.ndarray:
        made = super().vectors(weights)
        return _with_blank(made) if self.blank else made

    def spread(self, grad: np.ndarray, weights: dict) -> dict:
        return super().spread(grad[: len(self.known)], weights)


# --- scoring a table ---------------------------------------------------------------------


def score_texts(texts: list[str | None], model: tuple[dict[bytes, int], dict] | None) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    out = []
    for some in portions(texts, PORTION):
        windows = Windows([split_words(t) for t in some], model[0])
        logits = window_logits(model[1], windows, PORTION_WINDOWS)
        spans = np.searchsorted(windows.owner, np.arange(len(some)))
        out.append(sigmoid(np.maximum.reduceat(logits.astype(np.float64), spans)))
    return np.concatenate(out) if out else np.zeros(0)


def scores(text: str | Column, model: tuple[dict[bytes, int], dict] | None) -> Column:
    """The score of a text column by a trained model, which the function carries (under 3 MB)."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(texts.tolist(), model), dtype="float64")

    return F.pandas_udf(run, "double")(F.col(text) if isinstance(text, str) else text)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = PER_CLASS) -> tuple[dict[bytes, int], dict] | None:
    """Train on the labelled rows that ``usable`` admits."""
    return train(labelled_sample(docs, labels, "toxic", usable, per_class, LONGEST))


def keep_clean(docs: DataFrame, model: tuple[dict[bytes, int], dict] | None, text: str = "text", most: float = 0.5) -> DataFrame:
    """The rows that score below ``most``, all columns as they were."""
    return docs.filter(scores(text, model) < most)

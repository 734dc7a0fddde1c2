import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linklake.llm import gru_toxicity, mil_quality
from linklake.llm.common import crc_mod, table

from .helpers import awkward, no_docs, prose

GOOD_AND_BAD = [(prose(40 + i, i), 1) for i in range(60)] + [(" | ".join(prose(40 + i, 100 + i).split()), 0) for i in range(60)]


def mean_error(gradient, value, weights, rng):
    """Largest relative difference to the slope measured, over some entries of every array."""
    worst = 0.0
    for name, g in gradient.items():
        places = np.argwhere(np.abs(g) > 1e-6)
        for _ in range(3 if len(places) else 0):
            at = tuple(places[rng.integers(len(places))])
            kept = weights[name][at]
            weights[name][at] = kept + 1e-4
            up = value()
            weights[name][at] = kept - 1e-4
            down = value()
            weights[name][at] = kept
            slope = (up - down) / 2e-4
            worst = max(worst, abs(slope - g[at]) / max(1, abs(slope)))
    return worst


def test_gru_gradients():
    rng = np.random.default_rng(0)
    windows = gru_toxicity.Windows([[b"ab", b"cd", b"ab"], [b"x"], []], {b"ab": 1, b"cd": 2})
    weights = {k: v.astype(np.float64) for k, v in gru_toxicity.new_weights(2).items()}
    places, mask = windows.block(np.arange(len(windows.owner)))
    used, local = np.unique(places, return_inverse=True)
    part, local, slope = gru_toxicity._Part(windows.inputs, used), local.reshape(places.shape), rng.standard_normal(3)
    keep = {}
    value = lambda: float((gru_toxicity.forward(weights, part.vectors(weights), local, mask) * slope).sum())
    gru_toxicity.forward(weights, part.vectors(weights), local, mask, keep)
    gradient = gru_toxicity.backward(weights, part, part.vectors(weights), local, mask, keep, slope)
    assert mean_error(gradient, value, weights, rng) < 2e-3


def test_mil_gradients():
    rng = np.random.default_rng(0)
    x, counts = mil_quality.encode(["a b c. D!", "", None, "zz " * 500 + "Ab,c d!e " * 300])
    weights, slope = {k: v.astype(np.float64) for k, v in mil_quality.new_weights().items()}, np.array([1.0, -2.0, 0.5, 1.0])
    gradient = mil_quality.backward(weights, x, counts, mil_quality.forward(weights, x, counts)[1], slope)
    assert mean_error(gradient, lambda: float((mil_quality.forward(weights, x, counts)[0] * slope).sum()), weights, rng) < 2e-3


def test_passages_cover_the_text():
    for text in (b"", b"x" * 5000, prose(2000).encode(), b"a\nb " * 900):
        assert b"".join(mil_quality.passages(text)) == text


def test_windows_cover_the_text_and_overlap():
    for n in (0, 1, 95, 96, 97, 176, 177, 1000):
        words = [b"w%d" % i for i in range(n)]
        held = gru_toxicity.Windows([words], {})
        seen = set()
        for s, size in zip(held.start.tolist(), held.size.tolist(), strict=True):
            seen |= set(range(s, s + size))
        assert seen == set(range(n))
        assert all(b - a <= gru_toxicity.STRIDE for a, b in zip(held.start.tolist(), held.start.tolist()[1:], strict=False))


def test_window_scores_equal_the_training_network():
    windows = gru_toxicity.Windows([prose(150, i).encode().split() for i in range(3)] + [[]], {b"the": 1})
    weights = gru_toxicity.new_weights(1)
    places, mask = windows.block(np.arange(len(windows.owner)))
    vectors = gru_toxicity._with_blank(windows.inputs.vectors(weights))
    one = gru_toxicity.forward(weights, vectors, places, mask)
    assert np.allclose(one, gru_toxicity.window_logits(weights, windows, block=2), atol=1e-4)


def test_score_does_not_depend_on_the_batch():
    model = mil_quality.train(GOOD_AND_BAD, epochs=3)
    texts = [t for t, _ in GOOD_AND_BAD[:5]] + [None, "", prose(3000, 7)]
    alone = np.concatenate([mil_quality.score_texts([t], model) for t in texts])
    assert np.allclose(alone, mil_quality.score_texts(texts, model), atol=1e-5)


@pytest.mark.parametrize(("kind", "label", "n", "part"), [(mil_quality, "quality", 3, 1), (gru_toxicity, "toxic", 5, 0)])
def test_held_out_accuracy(spark, data, kind, label, n, part):
    sf_dir = data.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_mod("doc_id", n) == part
    model = kind.fit(docs, labels, ~held_out)
    rows = docs.join(labels, "doc_id").select("doc_id", label, held_out.alias("h"), kind.scores("text", model).alias("score")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % n == part) and 0 <= r.score <= 1 for r in rows)
    right = [(r.score >= 0.5) == (r[label] == 1) for r in rows if r.h]
    assert sum(right) / len(right) > 0.9


@pytest.mark.parametrize("kind", [mil_quality, gru_toxicity])
def test_awkward_rows_and_missing_classes(spark, kind):
    docs = awkward(spark)
    none = kind.fit(no_docs(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"), F.lit(True))
    assert none is None
    only = spark.createDataFrame([(1, 1, 1), (8, 1, 1), (None, 0, 0), (12, None, None)], "doc_id long, quality int, toxic int")
    assert kind.fit(docs, only, F.lit(True)) is None
    both = spark.createDataFrame([(1, 1, 1), (8, 0, 0), (8, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    model = kind.fit(docs, both, F.lit(True))
    for m in (none, model):
        rows = docs.select("doc_id", "text", kind.scores("text", m).alias("own")).collect()
        assert len(rows) == 18 and all(0 <= r.own <= 1 for r in rows)
        same = {r.text: set() for r in rows}
        for r in rows:
            same[r.text].add(round(r.own, 5))
        assert all(len(s) == 1 for s in same.values())
    assert no_docs(spark).select(kind.scores("text", model)).collect() == []


def test_toxicity_is_scored_in_small_portions(monkeypatch):
    texts = [None, "", *[f"word{i} and other words here " * 400 for i in range(300)], "one " * 600_000]
    vocabulary = {b"word1": 1, b"and": 2, b"one": 3}
    weights, windows, logits = gru_toxicity.new_weights(3), gru_toxicity.Windows, gru_toxicity.window_logits
    portions, blocks = [], []
    monkeypatch.setattr(gru_toxicity, "Windows", lambda some, known: (portions.append([sum(map(len, t)) for t in some]), windows(some, known))[1])
    monkeypatch.setattr(gru_toxicity, "window_logits", lambda w, of, block=2048: (blocks.append(block), logits(w, of, block))[1])
    got = gru_toxicity.score_texts(texts, (vocabulary, weights))
    alone = np.array([logits(weights, windows([gru_toxicity.split_words(t)], vocabulary)).max() for t in texts], float)
    assert abs(got - 1 / (1 + np.exp(-alone))).max() < 1e-6
    assert all(sum(p[:-1]) < 1_000_000 for p in portions) and max(blocks) <= 512  # a portion ends with the text that fills it

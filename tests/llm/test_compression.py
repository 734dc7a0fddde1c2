import glob
import math
import random
import re
from collections import Counter

import pytest
import zstandard

from linklake.llm import compression

from .helpers import awkward, no_docs, prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    held = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    failed = len(words) < 10 or 100 * len(held) > 20 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(held), failed


def test_base_counts_match_brute_force(spark):
    docs = awkward(spark)
    got = {(r.doc_id, r.text): r.m for r in docs.select("doc_id", "text", compression.measures("text").alias("m")).collect()}
    assert len(got) == 17
    for (_, text), m in got.items():
        assert tuple(m)[:6] == brute(text)
        assert not (m.base_failed and m.kept)


def test_repeats_in_small_alphabets():
    rng = random.Random(8)
    for _ in range(300):
        text = " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        assert compression.repeated_words(text.encode().split()) == brute(text)[4]


@pytest.mark.parametrize(
    ("text", "kept"),
    [(prose(50), True), (prose(5000, 2), True), ("same words again and " * 60, False), (" ".join(f"w{i % 7}" for i in range(5000)), False)],
)
def test_bands(spark, text, kept):
    row = spark.createDataFrame([(text,)], "text string").select(compression.measures("text").alias("m")).first().m
    assert row.kept is kept


def test_incompressible_text_is_rejected(spark):
    rng = random.Random(1)
    noise = " ".join("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(12)) for _ in range(2000))
    row = spark.createDataFrame([(noise,)], "text string").select(compression.measures("text").alias("m")).first().m
    assert not row.base_failed and not row.kept


def test_one_bad_stretch_of_a_long_text_shows_in_its_chunks():
    text = prose(3000, 4) + " " + "z " * 10_000 + prose(3000, 6)
    worst, share = compression.chunk_ratios(text.encode(), compression.LIMITS, zstandard.ZstdCompressor(level=3).compress)
    assert worst > 100 and 0.2 < share < 0.6


def test_filter_keeps_all_columns(spark):
    docs = awkward(spark)
    kept = compression.keep_ordinary(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 8, 12, None, 11}
    assert compression.keep_ordinary(no_docs(spark)).collect() == []


SQUEEZE = zstandard.ZstdCompressor(level=3).compress


def laden(text, seed):
    rng = random.Random(seed)
    return " ".join(w + rng.choice(("&&&", "%%%", "$$$", "***")) for w in text.split())


def labelled(spark, lengths, per_length):
    """Clean texts labelled 1 of every length, and symbol-laden ones labelled 0."""
    rows = [(i, prose(n + i % 50, i)) for i, n in enumerate(n for n in lengths for _ in range(per_length))]
    docs = rows + [(10_000 + i, laden(t, i)) for i, t in rows]
    labels = [(i, int(i < 10_000), 0) for i, _ in docs] + [(None, 1, 0), (0, 1, 0), (10_000, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_limits_follow_the_labelled_documents(spark):
    docs, labels = labelled(spark, (60, 400, 900, 2500), 60)
    limits = compression.fit_limits(docs, labels)
    assert limits != compression.LIMITS
    for n in (80, 450, 930, 2600):
        clean = prose(n, 70_000 + n)
        assert compression.assess(clean, limits, SQUEEZE)[6]
        if n > 400:
            assert not compression.assess(laden(clean, n), limits, SQUEEZE)[6]
    kept = {r.doc_id for r in compression.keep_ordinary(docs, limits=limits).select("doc_id").collect()}
    assert len([i for i in kept if i < 10_000]) >= 239 and len([i for i in kept if i >= 10_120]) < 10
    assert compression.fit_limits(docs, labels.filter("doc_id < 3")) == compression.LIMITS
    assert compression.fit_limits(no_docs(spark), labels) == compression.LIMITS
    at = [b[0] for b in limits.bands]
    assert at == sorted(at) and compression.band(1 << 30, limits)[1] > 3


def test_ratios_are_worked_out_once_a_text(spark, monkeypatch):
    """One function in the plan, so that a task holds one worker, and empty texts don't reach it."""
    docs, labels = labelled(spark, (60, 400), 60)
    plans, write = [], compression.cut_lineage
    monkeypatch.setattr(compression, "cut_lineage", lambda df: plans.append(df) or write(df))
    blank = spark.createDataFrame([(1, ""), (2, None), (None, "a b")], "doc_id long, text string")
    limits = compression.fit_limits(docs, labels)
    assert plans[0]._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert compression.fit_limits(docs.select("doc_id", "text").union(blank), labels) == limits != compression.LIMITS


def test_verdict_equals_a_plain_restatement(spark):
    limits = compression.Limits(bands=((10, 0.5, 2.0), (1000, 1.0, 2.2), (100_000, 1.5, 2.5)), chunk=500, chunk_low=1.1, chunk_high=3.0, chunk_share=0.3)
    texts = [prose(n, n) for n in (9, 30, 200, 2000)] + [prose(200, 1) + " z" * 600, "abc " * 9, laden(prose(300, 2), 1)]
    for text in texts:
        data = text.encode()
        x = math.log2(len(data))
        ends = [(math.log2(b), low, high) for b, low, high in limits.bands]
        (x0, l0, h0), (x1, l1, h1) = next(((p, q) for p, q in zip(ends, ends[1:]) if p[0] <= x <= q[0]), (ends[0], ends[1]))
        t = min(max((x - x0) / (x1 - x0), 0), 1)
        bad = 0
        for k in range(0, len(data), 500) if len(data) > 500 else ():
            part = data[k : k + 500] if k + 500 <= len(data) else data[-500:]
            bad += (not 1.1 <= 500 / len(SQUEEZE(part)) <= 3.0) * min(500, len(data) - k)
        ratio = len(data) / len(SQUEEZE(data))
        kept = not brute(text)[5] and l0 + t * (l1 - l0) <= ratio <= h0 + t * (h1 - h0) and bad / len(data) <= 0.3
        assert compression.assess(text, limits, SQUEEZE)[6] == kept


def test_ordinary_prose_stays_without_a_sample():
    """Licence texts of the system, and passages in other scripts; the base rule alone may reject them."""
    texts = [open(f, encoding="utf-8").read() for f in glob.glob("/usr/share/common-licenses/*")]
    rng = random.Random(6)
    scripts = [(0x430, 0x44F), (0x3B1, 0x3C9), (0x5D0, 0x5EA), (0x3042, 0x3090)]
    for low, high in scripts:
        stock = ["".join(chr(rng.randint(low, high)) for _ in range(rng.randint(2, 8))) for _ in range(1500)]
        for n in (40, 400, 4000):
            texts.append(" ".join(stock[min(1499, int(rng.expovariate(1 / 250)))] for _ in range(n)))
    found = [compression.assess(t, compression.LIMITS, SQUEEZE) for t in texts]
    assert all(f[6] for f in found if not f[5]) and sum(not f[5] for f in found) > 8


def test_very_long_lines_and_repetition_without_a_sample():
    noise = random.Random(2).randbytes(1_500_000).decode("latin-1")
    assert not compression.assess(noise, compression.LIMITS, SQUEEZE)[6]
    block = prose(400, 3)
    assert not compression.assess(" ".join([block] * 300), compression.LIMITS, SQUEEZE)[6]
    assert compression.assess(prose(150_000, 4), compression.LIMITS, SQUEEZE)[7] > 900_000

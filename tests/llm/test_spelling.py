import random
import zlib
from collections import Counter

import re

from linklake.llm import spelling

from .helpers import awkward, awkward_rows, no_docs


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(rows, shortest=6, fewest=5):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= shortest:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= fewest}


def brute(n, factor=5):
    out = {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= factor * n[w] else None
        out[w] = (form, len(close), n[form] if form else None)
    rows = set()
    for w, (form, k, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n[w], k, form_n))
    return rows


def made_up(seed, count):
    rng = random.Random(seed)
    words = set()
    while len(words) < count:
        w = "".join(rng.choice("abéÿ") for _ in range(rng.randint(6, 9)))
        words.add(w)
    return {w: rng.choice([5, 6, 30, 30, 200, 1500]) for w in words}


def test_variants_equal_brute_force_whatever_the_blocks(spark):
    n = made_up(1, 700)
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    for block in (8192, 20):
        got = [tuple(r) for r in spelling.variants(words, block=block).collect()]
        assert len(got) == len(n) and set(got) == brute(n)


def test_tiles_smaller_than_blocks():
    import numpy as np

    n = made_up(2, 300)
    for longer in (6, 7, 8, 9):
        members = [w for w in n if len(w) in (longer, longer - 1)]
        w = spelling.Words(members, np.array([n[x] for x in members]), np.zeros(len(members), np.int64))
        pairs = {frozenset((w.words[i], w.words[j])) for x, y in spelling.near_pairs(w, longer, 0, tile=7) for i, j in zip(x, y)}
        assert pairs == {frozenset((a, b)) for a in members for b in members if near(a, b) and max(len(a), len(b)) == longer}


def test_words_of_awkward_texts(spark):
    rows = [(i, t) for i, t, *_ in awkward_rows()]
    expected = brute_counts(rows)
    got = dict(map(tuple, spelling.counts(awkward(spark)).collect()))
    assert got == expected and len(got) > 50
    assert spelling.variants(spelling.counts(no_docs(spark))).collect() == []


def test_chain_of_forms_and_other_scripts(spark):
    n = {"abcdef": 5, "abcdeg": 25, "abcdeh": 125, "abcdeiX": 3000, "abcdei": 625, "中文字母表一二": 10, "中文字母表一三": 50, "x" * 4000: 5, "x" * 4001: 25}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert {tuple(r) for r in spelling.variants(words).collect()} == brute(n)


def test_registered_query(spark, data):
    from linklake.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    n = brute_counts(docs)
    got = {r.word: r for r in QUERIES["op13_spelling_variants"](spark, data).collect()}
    assert {w: r.n for w, r in got.items()} == n
    expected = {}
    halves = {}
    for w in n:
        for i in range(len(w)):
            halves.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
    for w in n:
        close = {x for i in range(len(w)) for x in halves[i, w[:i] + w[i + 1 :]]} - {w}
        close = {x for x in close if len(x) == len(w)}
        close |= {w[:i] + w[i + 1 :] for i in range(len(w))} & n.keys()
        expected[w] = close
    for w in n:
        for x in [x for x in expected[w] if len(x) < len(w)]:
            expected[x].add(w)
    for w, close in expected.items():
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= 5 * n[w] else None
        assert (got[w].n_near, got[w].form, got[w].form_n) == (len(close), form, n.get(form))

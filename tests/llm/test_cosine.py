import math

import numpy as np

from linklake.llm import cosine_lsh

SCHEMA = "vec_id long, embedding array<float>, label int, node string, weight string, vec int"


def planted(n, d, seed):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, d))
    for i in range(n // 2, n):  # near copies at angles on both sides of the threshold
        base = v[i - n // 2] / np.linalg.norm(v[i - n // 2])
        side = rng.standard_normal(d)
        side -= side @ base * base
        angle = math.acos(rng.uniform(0.86, 1.0))
        v[i] = math.cos(angle) * base + math.sin(angle) * side / np.linalg.norm(side)
    return v.astype(np.float32)


def brute(ids, vectors):
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    root = list(range(len(ids)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = top(int(i)), top(int(j))
        root[max(a, b)] = min(a, b)
    least = {}
    for k, i in enumerate(ids):
        least[top(k)] = min(i, least.get(top(k), i))
    return {i: (int(linked[k].sum()), least[top(k)]) for k, i in enumerate(ids)}, linked


def run(spark, rows, **more):
    data = [(i, None if v is None else [None if x is None else float(x) for x in v], None, "a", "b", 1) for i, v in rows]
    return {(r.vec_id): (r.n_links, r.component_id, r.kept) for r in cosine_lsh.near_duplicates(spark.createDataFrame(data, SCHEMA), **more).collect()}


def test_recall_and_exactness(spark):
    v = planted(800, 24, 1)
    expected, linked = brute(range(800), v)
    got = run(spark, list(enumerate(v)))
    assert len(got) == 800
    assert all(got[i][0] <= expected[i][0] for i in got)  # none below the threshold, none twice
    assert sum(x[0] for x in got.values()) >= 0.95 * linked.sum()
    assert all(k == (i == c) for i, (_, c, k) in got.items())


def test_large_buckets_in_blocks_are_exact(spark, monkeypatch):
    monkeypatch.setattr(cosine_lsh, "tables_and_bits", lambda n, *a: (3, 1))  # two buckets a table
    v = planted(300, 8, 2)
    expected, _ = brute(range(300), v)
    monkeypatch.setattr(cosine_lsh, "tables_and_bits", lambda n, *a: (12, 1))
    got = run(spark, list(enumerate(v)), block=40)
    assert {i: x[:2] for i, x in got.items()} == expected


def test_unusable_vectors_copies_and_null_ids(spark):
    one, two = [1.0, 2.0, 3.0], [2.0, 4.0, 6.0]
    rows = [
        (5, one), (3, one), (9, two), (4, None), (6, []), (7, [0.0, 0.0, 0.0]), (8, [1.0, None, 2.0]), (10, [1.0, math.inf, 0.0]),
        (11, [math.nan, 1.0, 1.0]), (12, [1.0, 2.0]), (13, [-1.0, -2.0, -3.0]), (None, [1.0, 2.0, 3.1]), (14, [1e-38, 2e-38, 3e-38]),
    ]
    got = run(spark, rows)
    assert got[5] == (4, 3, False) and got[3] == (4, 3, True) and got[9] == (4, 3, False) and got[14] == (4, 3, False)
    assert got[None] == (4, 3, False)
    for alone in (4, 6, 7, 8, 10, 11, 12, 13):
        assert got[alone] == (0, alone, True)
    assert run(spark, []) == {}


def test_only_null_ids(spark):
    assert run(spark, [(None, [1.0, 0.0])]) == {None: (0, None, True)}


def test_tables_follow_the_recall_asked_for():
    for n in (100, 10**5, 10**8):
        tables, bits = cosine_lsh.tables_and_bits(n)
        same = (1 - math.acos(0.9) / math.pi) ** bits
        assert 1 - (1 - same) ** tables >= 0.98
        assert n / 2**bits <= cosine_lsh.BUCKET

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from linklake.llm import simhash
from linklake.llm.components import components

from .helpers import awkward, awkward_rows, no_docs, prose


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=4):
    """Component id of each (id, fingerprint) row."""
    prints = sorted({fp for _, fp in rows})
    root = {p: p for p in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= radius:
                root[top(a)] = top(b)
    ids = {}
    for i, fp in rows:
        if i is not None:
            ids[top(fp)] = min(i, ids.get(top(fp), i))
    return [ids.get(top(fp)) for _, fp in rows]


def test_fingerprints(spark):
    for _, text, *_ in awkward_rows():
        assert simhash.fingerprint(text) == brute_print(text)


def test_near_duplicates_match_brute_force(spark):
    got = simhash.near_duplicates(awkward(spark)).select("doc_id", simhash.as_hex("fingerprint").alias("fp"), "component_id").collect()
    rows = [(i, brute_print(t)) for i, t, *_ in awkward_rows()]
    expected = [(i, f"{fp:016x}", c) for (i, fp), c in zip(rows, brute_components(rows), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert simhash.near_duplicates(no_docs(spark)).collect() == []


def _clustered(n, seed):
    """Random fingerprints, near copies of some, and a chain in which only neighbours link."""
    rng = random.Random(seed)
    values = [rng.getrandbits(64) for _ in range(n)]
    for v in values[: n // 4]:
        values.append(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    at = rng.getrandbits(64)
    for _ in range(40):
        at ^= sum(1 << b for b in rng.sample(range(64), 4))
        values.append(at)
    return list(dict.fromkeys(values))


def test_forest_matches_brute_force():
    values = _clustered(400, 1)
    left, right = np.array(values[:250], np.uint64), np.array(values[250:], np.uint64)
    for pair in ((np.array(values, np.uint64), None), (left, right)):
        member, root = simhash.forest(*pair, 4)
        groups = {}

        def top(x, groups=groups):
            while groups.get(x, x) != x:
                x = groups[x]
            return x

        for a, b in zip(member.tolist(), root.tolist(), strict=True):
            groups[max(top(a), top(b))] = min(top(a), top(b))
        known = {}
        both = values if pair[1] is None else None
        for i, a in enumerate(values):
            for b in values[:i]:
                if (a ^ b).bit_count() <= 4 and (both or (a in set(left.tolist())) != (b in set(left.tolist()))):
                    ra, rb = a, b
                    while known.get(ra, ra) != ra:
                        ra = known[ra]
                    while known.get(rb, rb) != rb:
                        rb = known[rb]
                    known[max(ra, rb)] = min(ra, rb)

        def truth(x):
            while known.get(x, x) != x:
                x = known[x]
            return x

        assert {top(v) for v in values} == {truth(v) for v in values}
        assert all(top(v) == truth(v) for v in values)


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "block_count", lambda n: 5)
    values = _clustered(500, 2)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    got = simhash.linked(spark.createDataFrame([(v,) for v in signed], "fingerprint long")).collect()
    root = {r.node: r.root for r in got}
    expected = brute_components([(i, v) for i, v in enumerate(values)])
    groups = {}
    for i, v in enumerate(signed):
        groups.setdefault(root.get(v, v), set()).add(expected[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(expected))


def test_components_of_a_long_path(spark):
    path = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1002, 1001), (7, 7)]
    random.Random(1).shuffle(path)
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000, 1002: 1000}
    assert components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_one_row_of_each_group_stays(spark):
    docs = awkward(spark)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    rows = [(i, brute_print(t)) for i, t, *_ in awkward_rows()]
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted({c for c in brute_components(rows) if c is not None})
    assert None not in got  # the null ids' groups hold an id
    assert simhash.keep_first(no_docs(spark)).collect() == []


def test_groups_without_ids_and_hot_groups(spark):
    text = prose(120, 4)
    rows = [(None, text)] * 3 + [(None, prose(120, 5))] + [(i, prose(150, 6)) for i in range(200)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 0), (True, 0), (True, 0)]


def test_spark_hash_is_the_same(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b c d")).alias("h")).first()
    assert row.h & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c d", 42)

import hashlib
import random
import zlib
from collections import defaultdict

from linklake.llm import list_rank, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + ts[h:])
    members, ended, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
            if d:
                kids[ts[: d - 1]].add(ts[:d])
        ended[ts].append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    return sorted(
        (min(cs), len(p), min(members[p[:-1]]) if p else -1, len(cs), len(kids[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ended[p]))).encode()).hexdigest())
        for p, cs in members.items()
    )


def made(frame):
    return sorted(tuple(-1 if x is None else x for x in r) for r in frame.collect())


def awkward_turns(seed=1):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 12), 99, 100, 101, 150, 205, 333, 3000]:
        for t in range(rng.choice([1, 2, 6, 9])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "user", None]), rng.choice(["a", "b", "中文👍", None, "", "long " * 50])))
    rows += [(7, 3, "user", "same")] * 4 + [(None, 1, "user", "x"), (500, None, None, None)]
    rows += [(c, t, "user", f"chain {t}") for c in (700, 701, 702) for t in range(40)]
    rows += [(900, t, "user", "x" * (t % 7)) for t in range(3000)]
    return rows


def test_trie_equals_brute_force(spark):
    rows = awkward_turns()
    table = spark.createDataFrame([(*r, 1, "n") for r in rows], SCHEMA + ", depth int, x1 string").repartition(5)
    expected = brute(rows)
    assert made(prefix_trie.digested(table)) == expected
    assert made(prefix_trie.digested(table, part=300)) == expected  # many rounds, coin tosses among them


def test_conversations_as_they_are(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a"), (2, 1, "u", "c"), (3, 0, "v", "a")]
    nodes, ended = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))
    found = {(r.conv_id, r.depth): (r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in nodes.collect()}
    assert found == {(1, 0): (3, 2, 3, 1), (1, 1): (2, 2, 2, 1), (1, 2): (1, 0, 1, 0), (2, 2): (1, 0, 1, 0), (3, 1): (1, 0, 1, 0)}
    assert {r.conv_id for r in ended.collect()} == {1, 2, 3}


def test_empty_table(spark):
    (row,) = prefix_trie.digested(spark.createDataFrame([], SCHEMA)).collect()
    assert (row.conv_id, row.depth, row.n_convs, row.n_children, row.n_leaves, row.saved_tokens) == (None, 0, 0, 0, 1, 0)


def test_list_in_random_order_is_ranked(spark):
    rng = random.Random(4)
    arcs = rng.sample(range(10_000), 3000)
    near = [rng.randint(0, 5) for _ in arcs]
    rows = [(a, b, k, 1, a % 3, a) for a, b, k in zip(arcs, [*arcs[1:], list_rank.END], near)]
    table = spark.createDataFrame(rows, "arc long, next long, near long, n long, a long, b long")
    found = {r.arc: (r.before_n, r.before_a, r.before_b) for r in list_rank.ranked(table, part=400).collect()}
    a = b = 0
    for n, arc in enumerate(arcs):
        assert found[arc] == (n, a, b)
        a, b = a + arc % 3, b + arc


def test_registered_query(spark, data):
    from linklake.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert made(QUERIES["op11_prefix_trie"](spark, data)) == brute(rows)

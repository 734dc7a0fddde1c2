"""SimHash near-duplicates by tiled exact comparison.

Method: each text gets a 64-bit fingerprint. Distinct fingerprints are dealt into blocks; every pair
of blocks meets once, in one task. There the fingerprints of a block form tiles of equal population
counts in three segments of the word. A tile is compared, by exclusive-or and bit count, only with
tiles whose counts differ by no more than the radius in sum, because the distance can't be smaller.
A task returns a spanning forest of the links it finds, not the links, so a group of any size costs
one row per member and block; distributed connected components join the forests.

The work is quadratic in distinct fingerprints (about 2e9 pairs a second and core after skipping).
A fingerprint is copied once per block; blocks grow with the root of the table up to a million values.

Defined results: a null or empty text has fingerprint zero, linked like any other. Rows with equal
text or id share a component. Rows with a null id get their component's smallest id, null if it has none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket, cut_lineage
from .components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # (first bit, bits)
LEAST_BLOCK = 4096
LARGEST_BLOCK = 1 << 20
MOST_TASKS = 20_000


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned fingerprint: a bit is 1 if it is set in over half the hashes of the word shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    firsts, lasts = starts[: len(words) - size + 1], ends[size - 1 :]
    for at in range(0, len(firsts), 1 << 15):
        some = zip(firsts[at : at + (1 << 15)].tolist(), lasts[at : at + (1 << 15)].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in some], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = 2 * counts > len(firsts)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(text: str | Column) -> Column:
    """The fingerprint of a text column as a signed long."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x) for x in texts.tolist()], np.uint64).view(np.int64))

    return F.pandas_udf(run, "long")(F.col(text) if isinstance(text, str) else text)


def as_hex(fp: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


class _Tiles:
    """Fingerprints sorted by their segment population counts, with the tile bounds."""

    def __init__(self, values: np.ndarray):
        counts = np.stack([np.bitwise_count((values >> np.uint64(a)) & np.uint64((1 << n) - 1)) for a, n in SEGMENTS], 1).astype(np.int16)
        order = np.lexsort(counts.T[::-1])
        self.order, self.values, counts = order, values[order], counts[order]
        new = np.flatnonzero(np.r_[True, (counts[1:] != counts[:-1]).any(axis=1)]) if len(values) else np.zeros(0, np.int64)
        self.starts, self.ends, self.counts = new, np.r_[new[1:], len(values)], counts[new]


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return up
        parent = up


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between ``left`` and ``right``, or within ``left``: (member, root) values."""
    values = left if right is None else np.concatenate([left, right])
    a, shift = _Tiles(left), 0 if right is None else len(left)
    b = a if right is None else _Tiles(right)
    root = np.arange(len(values))
    ids_b = b.order + shift
    for k in range(len(a.starts)):
        near = np.abs(b.counts - a.counts[k]).sum(axis=1) <= radius
        if right is None:
            near[:k] = False
        if not near.any():
            continue
        cols = np.concatenate([np.arange(s, e) for s, e in zip(b.starts[near], b.ends[near], strict=True)])
        across = b.values[cols]
        step = max(1, (1 << 19) // len(cols))
        for s in range(a.starts[k], a.ends[k], step):
            e = min(s + step, a.ends[k])
            hit_row, hit_col = np.nonzero(np.bitwise_count(a.values[s:e, None] ^ across[None, :]) <= radius)
            p, q = root[a.order[s + hit_row]], root[ids_b[cols[hit_col]]]
            apart = p != q
            if apart.any():
                _unite(root, np.unique(np.stack([p[apart], q[apart]], 1), axis=0))
                root = _roots(root)
    member = np.flatnonzero(root != np.arange(len(root)))
    return values[member], values[root[member]]


def _unite(parent: np.ndarray, pairs: np.ndarray) -> None:
    up = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for x, y in pairs.tolist():
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    for x in list(up):
        parent[x] = top(x)


def block_count(n: int) -> int:
    """Blocks grow with the root of the table, so that blocks times table, the rows copied, stays small."""
    size = min(max(LEAST_BLOCK, int(32 * n**0.5)), LARGEST_BLOCK)
    return max(1, -(-n // size))


def linked(prints: DataFrame, radius: int = RADIUS, column: str = "fingerprint") -> DataFrame:
    """(node, root) of all fingerprints that link with another; ``prints`` holds distinct ones, written down."""
    n = block_count(prints.count())
    # a block holds at most LARGEST_BLOCK values (8 MB) but for the spread of a hash
    blocks = prints.groupBy(bucket(n, column).alias("block")).agg(F.collect_list(column).alias("held"))
    meet = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pairs = blocks.withColumn("other", meet).select(
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "held"
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        held = [np.asarray(x, np.int64).view(np.uint64) for x in group["held"]]
        if len(held) == 1 and group["low"].iloc[0] != group["high"].iloc[0]:  # the other block is empty
            return pd.DataFrame({"src": [], "dst": []}, dtype="int64")
        member, root = forest(held[0], held[1] if len(held) == 2 else None, radius)
        return pd.DataFrame({"src": member.view(np.int64), "dst": root.view(np.int64)})

    # as many tasks as pairs of blocks, so that pairs aren't put together for their few bytes
    dealt = pairs.repartition(min(n * (n + 1) // 2, MOST_TASKS), "low", "high")
    return components(dealt.groupBy("low", "high").applyInPandas(compare, "src long, dst long"))


def _labelled(docs: DataFrame, doc_id: str, text: str, radius: int) -> tuple[DataFrame, DataFrame]:
    """Narrow rows (doc_id, text_hash, fingerprint), and the root and component id of every fingerprint."""
    marked = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), fingerprints(text).alias("fingerprint"))
    marked = cut_lineage(marked)
    prints = cut_lineage(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    roots = linked(prints.select("fingerprint"), radius)
    named = prints.join(roots, prints["fingerprint"] == roots["node"], "left")
    named = cut_lineage(named.select("fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")))
    least = cut_lineage(named.groupBy("root").agg(F.min("first_id").alias("component_id")))
    return marked, cut_lineage(named.join(least, "root").select("fingerprint", "root", "component_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: its id, signed fingerprint and component id."""
    marked, labels = _labelled(docs, doc_id, text, radius)
    return marked.join(labels, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each near-duplicate group, all columns as they were: the row of the smallest id.

    Null ids come last. Of rows with that id the one with the smallest hash of its text stays, and of
    wholly equal rows one. Texts are shuffled once; the groups are worked out on narrow rows.
    """
    marked, labels = _labelled(docs, doc_id, text, radius)
    null, number = F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", F.lit(0)).alias("_id")
    rank = F.struct(null, number, F.col("text_hash").alias("_hash"))
    first = marked.join(labels, "fingerprint").groupBy("root").agg(F.min(rank).alias("first")).select("first.*")
    key = ["_null", "_id", "_hash"]
    # the row travels as one column, so that its own columns may have any names
    own = docs.select(F.struct("*").alias("_row"), F.col(doc_id).isNull().alias("_null"), F.coalesce(doc_id, F.lit(0)).alias("_id"), F.xxhash64(text).alias("_hash"))
    return own.join(cut_lineage(first), key, "left_semi").dropDuplicates(key).select("_row.*")

"""Spelling variant groups by dense tiling with common prefixes and suffixes.

Method: distinct words become rows of padded code-point matrices, one padded at the right, one at the left. A tile is a
block of words against a block of words, compared whole by numpy: equal columns from the left give each pair's
common prefix, from the right its common suffix. Two words are a single edit apart exactly if these two lengths together
reach the longer length minus one. One of the two is then at least half of that, so a pair of blocks is left out
when it can't share so much: words are dealt by the length of the longer word, the side, and the half on that side.

A hot half is cut into blocks of at most ``BLOCK`` words by a hash of the word, and every pair of its blocks is a tile of
its own, so no task holds more than two blocks. A pair that shares both halves counts on the left side only. A
task returns one row a word with its count of near words and the best of them, never the pairs.

Forms point to words at least ``FACTOR`` times as frequent, so they hold no cycle, and roots are found by doubling
in as many rounds as the logarithm of the longest chain.

Defined results: null and empty texts have no words; equal rows count each; a null id counts as the empty text in the
checksum; an empty table gives no rows; a word of any length is kept whole. Ties between near words go to the smallest in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut_lineage, runs

RUNS = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EVERY = 199
SHORTEST, FEWEST, FACTOR = 6, 5, 5
BLOCK = 8192
TILE = 512


def words_of(text: str) -> Column:
    """Maximal runs of Latin letters, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(RUNS), F.lit(0))


def misspelled(doc_id: Column, word: Column) -> Column:
    """The word as it counts: one run in ``EVERY``, chosen by checksum, loses one code point."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % EVERY == 0, F.overlay(word, F.lit(""), at + 1, F.lit(1))).otherwise(word)


def counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """(word, n): words of at least ``shortest`` code points found at least ``fewest`` times in all texts."""
    found = docs.select(F.col(doc_id).alias("id"), F.explode(words_of(text)).alias("run")).filter(F.length("run") >= shortest)
    words = found.select(misspelled(F.col("id"), F.col("run")).alias("word")).filter(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= fewest)


def dealt(words: DataFrame, block: int) -> DataFrame:
    """(tile, longer, side, block, word, n): every word in each tile it may have near words in.

    Two words belong together if the longer has ``longer`` code points and they share the first or last ``longer // 2``.
    """
    sides = F.array(*[F.struct(F.lit(s).cast("int").alias("side"), (F.length("word") + d).cast("int").alias("longer")) for s in (0, 1) for d in (0, 1)])
    placed = words.select("word", "n", F.inline(sides))
    size = (F.col("longer") / 2).cast("int")
    affix = F.when(F.col("side") == 0, F.substr("word", F.lit(1), size)).otherwise(F.substr("word", F.length("word") - size + 1, size))
    placed = placed.withColumn("affix", affix)
    group = ["side", "longer", "affix"]
    hot = placed.groupBy(*group).agg(F.count("*").alias("members")).filter(F.col("members") > block)
    hot = hot.withColumn("blocks", F.ceil(F.col("members") / block).cast("int")).drop("members")
    placed = placed.join(hot, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.withColumn("other", others)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return placed.select(F.struct("side", "longer", "affix", low.alias("low"), high.alias("high")).alias("tile"), "side", "longer", "block", "word", "n")


class Words:
    """Words as padded matrices of code points, sorted by length."""

    def __init__(self, words: list[str], n: np.ndarray, block: np.ndarray):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        self.words = [words[i] for i in order]
        self.n, self.block, self.lengths = n[order], block[order], lengths[order]
        codes = np.frombuffer("".join(self.words).encode("utf-32-le", "surrogatepass"), "<u4")
        width = int(self.lengths[-1])
        kind = np.uint8 if codes.size and codes.max() < 256 else np.uint32
        row = np.repeat(np.arange(len(words)), self.lengths)
        column = np.arange(len(codes)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.left = np.zeros((width, len(words)), kind)
        self.right = np.zeros((width, len(words)), kind)
        self.left[column, row] = codes
        self.right[np.repeat(self.lengths, self.lengths) - 1 - column, row] = codes


def shared(columns: np.ndarray, a: slice, b: slice, width: int) -> np.ndarray:
    """Common prefix lengths of two blocks, up to ``width`` columns."""
    alive = np.ones((a.stop - a.start, b.stop - b.start), bool)
    length = np.zeros(alive.shape, np.int16)
    for column in columns[:width]:
        alive &= column[a, None] == column[None, b]
        if not alive.any():
            break
        length += alive
    return length


def near_pairs(w: Words, longer: int, side: int, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of near words, tile by tile: the first has ``longer`` code points, the second as many or one fewer."""
    first = int(np.searchsorted(w.lengths, longer))
    half = longer // 2
    apart = bool((w.block != w.block[0]).any())
    for i in range(first, len(w.words), tile):
        a = slice(i, min(i + tile, len(w.words)))
        for j in [*range(0, first, tile), *range(i, len(w.words), tile)]:
            b = slice(j, min(j + tile, first if j < first else len(w.words)))
            width = longer if j >= first else longer - 1
            prefix, suffix = shared(w.left, a, b, width), shared(w.right, a, b, width)
            near = prefix + suffix >= longer - 1
            if j >= first:
                near &= prefix < longer  # a word isn't near itself
                if i == j:
                    near = np.triu(near, 1)
            if side:
                near &= prefix < half  # found on the left side already
            if apart:
                near &= w.block[a, None] != w.block[None, b]
            x, y = np.nonzero(near)
            if len(x):
                yield x + i, y + j


def near_of(w: Words, longer: int, side: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the words that have near ones: their places, how many, and the place of the best."""
    n_near = np.zeros(len(w.words), np.int64)
    best = np.full(len(w.words), -1)
    # places in order of preference, so that the best near word is the one of smallest place
    order = sorted(range(len(w.words)), key=lambda i: (-w.n[i], w.words[i]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    top = np.full(len(w.words), len(w.words))
    for x, y in near_pairs(w, longer, side, tile):
        for one, other in ((x, y), (y, x)):
            np.add.at(n_near, one, 1)
            np.minimum.at(top, one, rank[other])
    found = np.flatnonzero(n_near)
    best[found] = np.array(order)[top[found]] if len(found) else best[found]
    return found, n_near[found], best[found]


NEAR = T.StructType([
    T.StructField("word", T.StringType()), T.StructField("n_near", T.LongType()),
    T.StructField("best_n", T.LongType()), T.StructField("best", T.StringType()),
])


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile to partial results a word."""
    schema = to_arrow_schema(NEAR)
    held: list[list] = [[], [], [], []]
    for part in runs(batches, lambda b: list(zip(*[b.column(0).field(k).to_pylist() for k in range(5)], strict=True))):
        if part.num_rows < 2:
            continue
        longer, side = part.column(2)[0].as_py(), part.column(1)[0].as_py()
        w = Words(part.column(4).to_pylist(), part.column(5).to_numpy(), part.column(3).to_numpy())
        if w.lengths[-1] < longer:
            continue
        found, n_near, best = near_of(w, longer, side)
        held[0] += [w.words[i] for i in found]
        held[1] += n_near.tolist()
        held[2] += w.n[best].tolist()
        held[3] += [w.words[i] for i in best]
        if len(held[0]) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(held, schema, strict=True)], schema=schema)
            held = [[], [], [], []]
    if held[0]:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(held, schema, strict=True)], schema=schema)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near ones."""
    tiles = dealt(words, block)
    tiles = tiles.repartition("tile").sortWithinPartitions("tile").select("tile", "side", "longer", "block", "word", "n")
    found = tiles.mapInArrow(compare, NEAR)
    # the greatest n, then the smallest word: code-point order is the order of UTF-8 bytes
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("best"))).alias("top")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("top.minus")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word with a form, by doubling."""
    at = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        met = cut_lineage(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = met.select("word", "root")
        if met.filter("moved").isEmpty():
            return at


def variants(words: DataFrame, factor: int = FACTOR, block: int = BLOCK) -> DataFrame:
    """One row a word of ``words`` (word, n): form, root, n, n_near, form_n."""
    words = cut_lineage(words.select("word", "n"))
    near = words.join(near_words(words, block), "word", "left")
    known = F.col("best_n") >= factor * F.col("n")
    made = cut_lineage(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(known, F.col("best")).alias("form"), F.when(known, F.col("best_n")).alias("form_n"),
    ))
    made = made.join(roots(made.filter("form is not null")), "word", "left")
    return made.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

Method: texts are cut into words (matches of the vocabulary's pattern), and a block of texts becomes one row: the
distinct words, letter by letter for their bytes, and each text as the places of its words among them. On that row Spark's
higher-order functions do the rest. A fold over each distinct word starts from the ids of its bytes and, step by
step, merges the neighbouring pair of lowest rank, leftmost first, by a literal rank map, until no pair has a rank.
Decoding turns ids into pieces and concatenates their bytes. A text's ids and decoding are those of its
words, joined in order.

A state of the fold is a string of one character a token, ordered like the ranks; two characters are a pair. The rank map is a
literal of small buckets, because Spark searches a map entry by entry; pairs of bytes, with which words start, are found by place.
The state of a word of at most ``SHORT`` bytes also holds what each pair makes: a step merges the leftmost place of the best pair
and looks up only the two pairs that this makes. In longer words a step looks up all pairs and merges all places of the best
one, or the leftmost alone where the token that it makes could change what comes next. A word longer than any token is
first cut between bytes that stand side by side in no token, as nothing merges across.

Every row is worked on alone: no shuffle, nothing remembered between blocks; a block holds ``BLOCK`` characters or one
longer text, so memory is bounded by the longest text.

Defined results: a null or empty text has no ids and decodes to nothing. Null ids, repeated rows and an empty
table are carried along; no column but ``keep`` and the text is read. There are no special tokens: their strings are text.
A text of any length is encoded whole; it stands in one row, as it does in the input.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BUCKETS = 1 << 16
BLOCK = 32 << 20
NONE = "\U0010ffff"
#: Stand for no token: between the entries of a bucket, and at both ends of a state.
BAR, EDGE = "\x01", "\x02"
#: Bytes of the words whose fold looks up only new pairs.
SHORT = 48
#: Bytes of a state above which its pairs are cut out in one go.
LONG = 256
MAP = "struct<merges: array<string>, first: array<string>, ids: array<string>, pieces: array<string>>"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def splits(ranks: dict[bytes, int]) -> Iterator[tuple[int, int, int]]:
    """The ranks of two tokens and of the token they make together, for every such pair."""
    for token, rank in ranks.items():
        for at in range(1, len(token)):
            left, right = ranks.get(token[:at]), ranks.get(token[at:])
            if left is not None and right is not None:
                yield left, right, rank


def unreachable(ranks: dict[bytes, int]) -> set[bytes]:
    """Tokens that merging their own bytes doesn't give; none in a vocabulary that was made by merging."""
    out = set()
    for token in ranks:
        pieces = [token[i : i + 1] for i in range(len(token))]
        while len(pieces) > 1:
            pairs = [ranks.get(a + b, len(ranks) << 8) for a, b in zip(pieces, pieces[1:], strict=False)]
            at = pairs.index(min(pairs))
            if pairs[at] == len(ranks) << 8:
                out.add(token)
                break
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
    return out


def letter(rank: int, alone: bool) -> str:
    """The character that stands for a token: ordered like the ranks, odd if it is touchy; surrogates, ``BAR`` and ``EDGE`` are left out."""
    at = 2 * rank + alone + 4
    return chr(at if at < 0xD800 else at + 0x800)


def touchy(ranks: dict[bytes, int]) -> set[int]:
    """Tokens whose making at one place may bear on another place of the same rank.

    Either they merge on at a rank below their own, or two different pairs that share a token make them.
    """
    out, ways = set(), {}
    for left, right, rank in splits(ranks):
        out.update(x for x in (left, right) if x > rank)
        ways.setdefault(rank, []).append((left, right))
    out.update(rank for rank, pairs in ways.items() if any(a != c and b == c for a, b in pairs for c, _ in pairs))
    return out


@lru_cache(maxsize=4)
def literal(path: str) -> str:
    """The rank map as JSON.

    A bucket is a string: a bar, ``NONE``, a bar, then a pair, a bar, the token it makes and a bar, again and again. So nothing but
    a pair stands between bars by twos. What follows a pair starts with a bar and its token; if the pair is missing, the whole
    string counts, which starts with a bar and ``NONE``. ``first`` has what each pair of bytes makes.
    """
    ranks = read_ranks(path)
    if odd := unreachable(ranks):
        raise ValueError(f"{len(odd)} tokens can't be reached by merging, such as {min(odd)!r}")
    alone = touchy(ranks)
    letters = {rank: letter(rank, rank in alone) for rank in ranks.values()}
    merges = [BAR + NONE + BAR] * BUCKETS
    made = {}
    for left, right, rank in splits(ranks):
        pair = letters[left] + letters[right]
        merges[xxhash.xxh64_intdigest(pair.encode(), 42) % BUCKETS] += pair + BAR + letters[rank] + BAR
        made[pair] = letters[rank]
    size = ord(max(letters.values())) + 1
    ids, pieces = [""] * size, [""] * size
    for piece, rank in ranks.items():
        at = ord(letters[rank])
        ids[at], pieces[at] = rank.to_bytes(4, "little").hex(), piece.hex()
    single = [letters[ranks[bytes([b])]] for b in range(256)]
    first = [made.get(a + b, NONE) for a in single for b in single]
    return json.dumps({"merges": merges, "first": first, "ids": ids, "pieces": pieces, "bytes": single}, separators=(",", ":"))


class Cutter:
    """Cuts texts into words, and words longer than any token where no token reaches across."""

    #: A text with white space before a space, or a space at an end, isn't cut at its spaces first.
    SPACED = re.compile(r"\s |\A | \Z")
    MARK = "\0"
    #: Latin letters, after a space or not: one word where the pattern takes such a run whole.
    LETTERS = " ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u02af]+"
    RUN = r" ?\p{L}+"
    #: ASCII marks after the letters: a second word where the pattern goes on like this.
    MARKS = r"[!-/:-@\[-`{-~]+"
    NEXT = r" ?\p{N}+| ?[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, pattern: str):
        # the vocabulary's library takes Unicode's white space, which leaves out four control characters that \s has here
        plain = pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.words = regex.compile(plain).findall
        before, run, after = pattern.partition("|" + self.RUN + "|")
        whole = run and all(x[:1] == "'" for x in before.split("|"))  # nothing earlier in the pattern starts with a letter or space
        marks = whole and after.startswith(self.NEXT + "|") and all(re.fullmatch("'[a-z]+", x) for x in before.split("|"))
        self.plain = re.compile(f"({self.LETTERS})({self.MARKS if marks else ''})?").fullmatch if whole else lambda text: None
        tokens = read_ranks(path)
        self.longest = max(map(len, tokens))
        self.beside = np.zeros(1 << 16, bool)
        for token in tokens:
            at = np.frombuffer(token, np.uint8).astype(np.int32)
            self.beside[at[:-1] * 256 + at[1:]] = True

    def parts(self, word: bytes) -> list[bytes]:
        if len(word) <= self.longest:
            return [word]
        at = np.frombuffer(word, np.uint8).astype(np.int32)
        cuts = np.flatnonzero(~self.beside[at[:-1] * 256 + at[1:]]) + 1
        ends = [0, *cuts.tolist(), len(word)]
        return [word[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def stretches(self, text: str | None) -> list[str]:
        """The text in stretches that can be cut into words one by one: from a space after something else to the next."""
        if not text:
            return []
        if text.replace("\n", "").isprintable():  # the only white space is spaces and ends of lines, which is told sooner
            spaced = "  " in text or "\n " in text or " " in (text[0], text[-1])
        else:
            spaced = self.SPACED.search(text)
        if spaced:
            return [text]
        if self.MARK not in text:
            return text.replace(" ", self.MARK + " ").split(self.MARK)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]


class Block(dict):
    """Texts as numbers of distinct stretches, and these as numbers of distinct words; gives each stretch its number."""

    def __init__(self, own: Cutter):
        self.own, self.texts, self.size = own, [], 0
        self.words: dict[bytes, int] = {}
        self.places, self.counts = array("i"), array("i")  # words of all stretches, and how many each has

    def __missing__(self, new: str) -> int:
        own, words = self.own, self.words
        one = new.encode("utf-8")
        if len(one) <= own.longest and (found := own.plain(new)):
            parts = [found[1].encode("utf-8"), found[2].encode("utf-8")] if found[2] else [one]
        else:
            parts = [p for w in own.words(new) for p in own.parts(w.encode("utf-8"))]
        for p in parts:
            self.places.append(words.setdefault(p, len(words)))
        self.counts.append(len(parts))
        self[new] = number = len(self)
        return number

    def add(self, texts: list[str | None]) -> None:
        for text in texts:
            cut = self.own.stretches(text)
            self.texts.append(np.fromiter(map(self.__getitem__, cut), np.int32, len(cut)))
            self.size += len(text or "")

    def numbered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A number for each stretch, that of its word, or a new one if it hasn't one word; the latter's counts and words."""
        counts, places = np.frombuffer(self.counts, np.int32), np.frombuffer(self.places, np.int32)
        one = counts == 1
        numbers = np.empty(len(counts), np.int32)
        numbers[one] = places[(np.cumsum(counts) - counts)[one]]
        numbers[~one] = len(self.words) + np.arange(np.count_nonzero(~one))
        return numbers, counts[~one], places[np.repeat(~one, counts)]


@lru_cache(maxsize=2)
def cutter(path: str, pattern: str) -> Cutter:
    return Cutter(path, pattern)


def _lists(lengths, flat: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind.value_type)).cast(kind)


def spelled(words: list[bytes], letters: np.ndarray, kind: pa.StructType) -> pa.StructArray:
    """The words by the ``letters`` of their bytes, and by the numbers of their pairs of bytes."""
    flat = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    sizes = np.array([len(chr(x).encode()) for x in letters], np.uint8)
    bounds = np.r_[0, np.cumsum(sizes[flat], dtype=np.int32)[ends - 1]].astype(np.int32)
    state = letters[flat].tobytes().decode("utf-32-le").encode()
    inside = np.ones(len(flat), bool)
    inside[ends - 1] = False  # pairs that would run into the next word
    pairs = (flat[:-1].astype(np.int32) * 256 + flat[1:])[inside[:-1]]
    states = pa.StringArray.from_buffers(len(words), pa.py_buffer(bounds), pa.py_buffer(state))
    return pa.StructArray.from_arrays([states.cast(kind.field("state").type), _lists(lengths - 1, pairs, kind.field("pairs").type)], fields=list(kind))


def blocks(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str, most: int) -> DataFrame:
    """One row per block: ``docs`` (kept columns and numbers of words or stretches), ``stretches`` (numbers of words), ``words``.

    Stretches that are one word are that word. The others are numbered after the words.
    """
    letters = np.array([ord(x) for x in json.loads(literal(path))["bytes"]], "<u4")
    kept = T.StructType([docs.schema[k] for k in keep])
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([
        T.StructField("docs", T.ArrayType(T.StructType([T.StructField("kept", kept), T.StructField("places", ints)]))),
        T.StructField("stretches", T.ArrayType(ints)),
        T.StructField("words", T.ArrayType(T.StructType([T.StructField("state", T.StringType()), T.StructField("pairs", ints)]))),
    ])
    arrow = to_arrow_schema(schema)
    names = list(dict.fromkeys([*keep, text]))

    def row(block: Block, columns: list[pa.RecordBatch]) -> pa.RecordBatch:
        block.clear()  # the stretches themselves aren't needed any more
        doc = arrow.field("docs").type.value_type
        fields = doc.field("kept").type
        table = pa.Table.from_batches(columns).combine_chunks()
        own = [table.column(k).combine_chunks().cast(fields.field(k).type) for k in keep]
        own = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in own]
        rows = pa.StructArray.from_arrays(own, fields=[fields.field(k) for k in keep])
        numbers, counts, places = block.numbered()
        stretches = _lists(counts, places, arrow.field("stretches").type.value_type)
        lengths, flat = [*map(len, block.texts)], numbers[np.concatenate(block.texts)]
        block.texts.clear()
        places = _lists(lengths, flat, doc.field("places").type)
        both = pa.StructArray.from_arrays([rows, places], fields=[doc.field("kept"), doc.field("places")])
        words = spelled(list(block.words), letters, arrow.field("words").type.value_type)
        block.words.clear()
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        made = [one(x).cast(arrow.field(n).type) for n, x in (("docs", both), ("stretches", stretches), ("words", words))]
        return pa.RecordBatch.from_arrays(made, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cutter(path, pattern)
        block, columns = Block(own), []
        for batch in batches:
            if not batch.num_rows:
                continue
            block.add(batch.column(names.index(text)).to_pylist())
            columns.append(batch.select(keep))
            if block.size >= most:
                yield row(block, columns)
                block, columns = Block(own), []
        if columns:
            yield row(block, columns)

    return docs.select(*names).mapInArrow(run, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)  # unlike transform, it copies nothing


def made_of(ranks: Column, pair: Column) -> Column:
    """The token that a pair makes, ``NONE`` if it doesn't merge."""
    def found(pair: Column) -> Column:
        bucket = F.get(ranks["merges"], F.xxhash64(pair).bitwiseAND(BUCKETS - 1).cast("int"))
        return F.substr(F.call_function("substring_index", bucket, pair, F.lit(-1)), F.lit(2), F.lit(1))

    return let(pair, found)


def quick_fold(ranks: Column, word: Column) -> Column:
    """What ``fold`` gives, for a word of few bytes: the state is held with what its pairs make, from edge to edge; nothing if it is over."""
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    pairs = F.transform(word["pairs"], lambda p: F.get(ranks["first"], p))
    start = F.struct(text(EDGE, word["state"], EDGE).alias("state"), text(NONE, F.array_join(pairs, ""), NONE).alias("makes"))

    def merged(held: Column, best: Column, at: Column) -> Column:
        def around(state: Column) -> Column:
            return let(F.substr(state, at - 1, F.lit(3)), lambda three: F.struct(state.alias("state"), beside(three).alias("makes")))

        def beside(three: Column) -> Column:
            left = F.when(at == 2, F.lit(NONE)).otherwise(made_of(ranks, F.substr(three, F.lit(1), F.lit(2))))
            right = F.when(at + 1 == F.length(held["makes"]), F.lit(NONE)).otherwise(made_of(ranks, F.substr(three, F.lit(2), F.lit(2))))
            return F.overlay(held["makes"], F.concat(left, right), at - 1, F.lit(3))

        return let(F.overlay(held["state"], best, at, F.lit(2)), around)

    def apply(held: Column, best: Column) -> Column:
        over = F.struct(held["state"].alias("state"), F.lit("").alias("makes"))
        return F.when(best == NONE, over).otherwise(let(F.call_function("instr", held["makes"], best), lambda at: merged(held, best, at)))

    def step(held: Column, _: Column) -> Column:
        return F.when(held["makes"] == "", held).otherwise(let(F.array_min(F.split(held["makes"], "")), lambda best: apply(held, best)))

    return F.aggregate(word["pairs"], start, step, lambda held: F.substr(held["state"], F.lit(2), F.length(held["state"]) - 2))


def fold(ranks: Column, word: Column) -> Column:
    """The tokens that the merges leave of a word's bytes, as a string."""
    def short(state: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(state) - 1), lambda i: made_of(ranks, F.substr(state, i, F.lit(2))))

    def long(state: Column) -> Column:
        return let(F.split(state, ""), lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: made_of(ranks, F.concat(a, b))))

    def merged(state: Column, values: Column, best: Column) -> Column:
        at = F.array_position(values, best).cast("int")
        return F.when(F.ascii(best).bitwiseAND(1) == 0, F.replace(state, F.substr(state, at, F.lit(2)), best)).otherwise(F.overlay(state, best, at, F.lit(2)))

    def apply(held: Column, values: Column) -> Column:
        over = F.struct(held["state"].alias("state"), F.lit(True).alias("over"))
        return let(F.array_min(values), lambda best: F.when(best == NONE, over).otherwise(
            F.struct(merged(held["state"], values, best).alias("state"), F.lit(False).alias("over"))))

    def step(held: Column, _: Column) -> Column:
        state = held["state"]
        values = F.when(F.octet_length(state) <= LONG, short(state)).otherwise(long(state))
        return F.when(held["over"] | (F.length(state) < 2), held).otherwise(let(values, lambda v: apply(held, v)))

    return F.aggregate(word["pairs"], F.struct(word["state"].alias("state"), F.lit(False).alias("over")), step, lambda held: held["state"])


def encoded_word(ranks: Column, word: Column) -> Column:
    """The ids (little-endian) and the decoded bytes, both in hexadecimal digits."""
    def spelled(tokens: Column) -> Column:
        text = lambda name: F.array_join(F.transform(tokens, lambda t: F.get(ranks[name], F.ascii(t))), "")
        return F.struct(text("ids").alias("ids"), text("pieces").alias("decoded"))

    tokens = F.when(F.size(word["pairs"]) < SHORT, quick_fold(ranks, word)).otherwise(fold(ranks, word))
    return let(F.split(tokens, ""), spelled)


def joined(known: Column, places: Column) -> Column:
    """The encodings at ``places`` as one."""
    def joint(found: Column) -> Column:
        return F.struct(F.array_join(found["ids"], "").alias("ids"), F.array_join(found["decoded"], "").alias("decoded"))

    return let(F.transform(places, lambda p: F.get(known, p)), joint)


def _texts(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str, most: int, finish: Callable[[Column], list[Column]]) -> DataFrame:
    """One row per text: kept columns, and what ``finish`` makes of ``ids`` and ``decoded``, in hexadecimal digits."""
    def one(known: Column, doc: Column) -> Column:
        return let(joined(known, doc["places"]), lambda m: F.struct(doc["kept"].alias("kept"), F.struct(*finish(m)).alias("made")))

    def block(ranks: Column) -> Column:
        words = F.transform("words", lambda w: encoded_word(ranks, w))
        both = let(words, lambda known: F.concat(known, F.transform("stretches", lambda s: joined(known, s))))
        return let(both, lambda known: F.transform("docs", lambda d: one(known, d)))

    rows = blocks(docs, path, pattern, keep, text, most).select(F.inline(let(F.from_json(F.lit(literal(path)), MAP), block)))
    return rows.select("kept.*", "made.*")


def encoded(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text", most: int = BLOCK // 4) -> DataFrame:
    """``keep`` columns, ``n_tokens``, the ids in bytes (little-endian unsigned 32-bit) and the decoded bytes."""
    return _texts(docs, path, pattern, keep, text, most, lambda m: [
        (F.octet_length(m["ids"]) / 8).cast("long").alias("n_tokens"), F.unhex(m["ids"]).alias("ids"), F.unhex(m["decoded"]).alias("decoded"),
    ])


def digests(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text", most: int = BLOCK) -> DataFrame:
    """``keep`` columns, ``n_tokens``, and SHA-256 of the ids and of the decoded bytes."""
    return _texts(docs, path, pattern, keep, text, most, lambda m: [
        (F.octet_length(m["ids"]) / 8).cast("long").alias("n_tokens"), F.sha2(F.unhex(m["ids"]), 256).alias("ids_sha256"), F.sha2(F.unhex(m["decoded"]), 256).alias("decoded_sha256"),
    ])
